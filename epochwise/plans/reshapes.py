"""Event JSON, answers, report merging, datasets, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions import coerce, hashing, text
from epochwise.functions.numbers import rnd
from epochwise.operators import compare, datasets, events, joins, readout
from epochwise.plans import views as v
from epochwise.plans.base import query, r, seed_sql
from epochwise.plans.projections import _LIST_SQL
from epochwise.plans.readouts import rounded
from epochwise.plans.trial import trial_log
from epochwise.plans.views import sql

STUDY = "STUDY-001"
_FIELDS = {
    "ae_id": "ae_id", "patient_id": "subject", "arm_id": "arm", "epoch": "epoch", "term": "term", "soc": "soc", "ctcae_grade": "grade",
    "serious": "serious", "relatedness": "relatedness", "predicted_probability": "p", "source": "source", "reported_verbatim": "verbatim",
}


def log_with_json(spark, d):
    """Subject-epochs with their events as JSON text; one in ten each is damaged."""
    packed = events.collect_events(v.ae_events(spark, d), ["subject", "epoch"], _FIELDS)
    m = (F.col("subject") + F.col("epoch")) % 10
    whole = F.col("events_json")
    damaged = (
        F.when(m == 0, F.concat(whole, F.lit("oops")))
        .when(m == 1, F.lit(None))
        .when(m == 2, F.lit('{"term": "alone"}'))
        .when(m == 3, F.concat(F.lit('["text", 5, {"ae_id": "x", "patient_id": "'), F.col("subject").cast("string"), F.lit('", "term": "odd", "ctcae_grade": "high"}]')))
        .when(m == 4, F.lit("[]"))
        .when(m == 5, F.substring(whole, 1, 20))
        .otherwise(whole)
    )
    return packed.select("subject", "epoch", damaged.alias("adverse_events_json"))


@query(
    "shp01_explode_events",
    sql(
        "ae_events",
        """, s AS (SELECT DISTINCT subject, epoch FROM ae_events WHERE (subject + epoch) % 10 = 3)
        SELECT ae_id, CAST(subject AS VARCHAR) AS patient_id, arm AS arm_id, epoch, term, soc, grade AS ctcae_grade, serious, relatedness, p AS predicted_probability,
               source, verbatim AS reported_verbatim FROM ae_events WHERE (subject + epoch) % 10 >= 6
        UNION ALL SELECT 'x', CAST(subject AS VARCHAR), NULL, -1, 'odd', NULL, 1, false, NULL, 0.0, NULL, NULL FROM s""",
    ),
)
def _(spark, d):
    return events.explode_events(log_with_json(spark, d)).withColumn("epoch", F.coalesce("epoch", F.lit(-1)))


@query(
    "shp02_collect_events",
    sql(
        "ae_events",
        """SELECT subject, epoch, '[' || string_agg('{"term":"' || term || '","grade":' || grade || ',"serious":' || CASE WHEN serious THEN 'true' ELSE 'false' END ||
           ',"source":"' || source || '"}', ',' ORDER BY term) || ']' AS events_json,
           string_agg(term || ' (G' || grade || ')', '; ' ORDER BY grade DESC, term)[1:480] AS summary FROM ae_events GROUP BY subject, epoch""",
    ),
)
def _(spark, d):
    fields = {"term": "term", "grade": "grade", "serious": "serious", "source": "source"}
    return events.collect_events(v.ae_events(spark, d), ["subject", "epoch"], fields)


# --- report merge --------------------------------------------------------------
def reports(spark, d):
    """Symptom reports: the likely terms restated, the others in words of their own, plus new complaints."""
    restated = F.when(F.col("p") > 0.4, F.concat(F.lit(" "), F.upper("term"), F.lit(" "))).otherwise(F.concat(F.lit("like "), F.col("term")))
    known = v.ae_events(spark, d).select(
        "subject", "arm", "epoch", restated.alias("term"),
        (1 + (F.col("grade") + 1) % 5).cast("int").alias("grade"), F.when(F.col("grade") % 2 == 0, "as told").otherwise("").alias("verbatim"),
    )
    fresh = v.obs_events(spark, d).select(
        "subject", "arm", "epoch", F.explode(F.array(F.lit("New ache"), F.lit("new ACHE "), F.lit("zz late one"))).alias("term"),
        (1 + F.col("subject") % 5).cast("int").alias("grade"), F.lit("it hurts").alias("verbatim"),
    )
    from pyspark.sql import Window as W

    # bounded: at most one report per term and subject-epoch
    place = F.row_number().over(W.partitionBy("subject", "epoch").orderBy(F.lower(F.trim("term")), "term")).cast("int")
    return known.unionByName(fresh).withColumn("position", place)


_REPORTS = """
, said AS (SELECT subject, arm, epoch, CASE WHEN p > 0.4 THEN ' ' || upper(term) || ' ' ELSE 'like ' || term END AS term, CAST(1 + (grade + 1) % 5 AS INTEGER) AS grade, CASE WHEN grade % 2 = 0 THEN 'as told' ELSE '' END AS verbatim
           FROM ae_events
  UNION ALL SELECT subject, arm, epoch, t, CAST(1 + subject % 5 AS INTEGER), 'it hurts' FROM obs_events, unnest(['New ache', 'new ACHE ', 'zz late one']) u(t)),
reps AS (SELECT *, lower(trim(term)) AS key FROM said QUALIFY row_number() OVER (PARTITION BY subject, epoch ORDER BY lower(trim(term)), term) <= 5),
best AS (SELECT subject, epoch, key, max(grade) AS g, max(verbatim) AS vb FROM reps GROUP BY ALL),
merged AS (
  SELECT a.ae_id, a.subject, a.arm, a.epoch, a.term, a.soc, CASE WHEN b.g > a.grade THEN b.g ELSE a.grade END AS grade,
         CASE WHEN b.g > a.grade THEN a.serious OR b.g >= 3 ELSE a.serious END AS serious, a.relatedness, a.p,
         CASE WHEN b.g > a.grade THEN 'hybrid' ELSE a.source END AS source, CASE WHEN b.vb <> '' THEN b.vb ELSE a.verbatim END AS verbatim
  FROM ae_events a LEFT JOIN best b ON b.subject = a.subject AND b.epoch = a.epoch AND b.key = lower(trim(a.term))
  UNION ALL
  SELECT sha256('run1|' || r.subject || '|' || r.epoch || '|' || r.key)[1:20], r.subject, r.arm, r.epoch, r.term, 'Reported by patient (LLM)', r.grade, r.grade >= 3, 'possible', 0.0, 'llm', r.verbatim
  FROM reps r WHERE NOT EXISTS (SELECT 1 FROM ae_events a WHERE a.subject = r.subject AND a.epoch = r.epoch AND lower(trim(a.term)) = r.key))"""


@query("joi05_report_merge", sql("obs_events ae_events", _REPORTS + " SELECT * FROM merged"))
def _(spark, d):
    return joins.merge_reports(v.ae_events(spark, d), reports(spark, d), "run1")


@query(
    "joi05_epoch_burden",
    sql("obs_events ae_events", _REPORTS + " SELECT subject, epoch, count(*) AS n_ae, max(grade) AS worst_grade FROM merged GROUP BY ALL"),
)
def _(spark, d):
    return joins.epoch_burden(joins.merge_reports(v.ae_events(spark, d), reports(spark, d), "run1"))


# --- response cache ---------------------------------------------------------------
_REQ = "sha256(role || '|m1|0.7000|sys|' || text || '|')[1:32]"
_CACHE = f"""WITH req AS (SELECT conv_id, turn, {_REQ} AS key FROM conversations UNION ALL SELECT conv_id + 1000000, turn, {_REQ} FROM conversations WHERE turn = 0),
cache AS (SELECT key, arg_min(response, ord) AS response FROM (SELECT {_REQ} AS key, 'r' || conv_id || '_' || turn AS response, conv_id * 100000 + turn AS ord
          FROM conversations WHERE conv_id % 3 = 0) GROUP BY key)"""


def requests_and_cache(spark, d):
    c = v.table(spark, d, "conversations")
    parts = (F.col("role"), "m1", "0.7000", "sys", F.col("text"), "")
    req = joins.with_request_key(c, *parts)
    again = req.where("turn = 0").withColumn("conv_id", F.col("conv_id") + 1000000)
    entries = req.where("conv_id % 3 = 0").select(
        "key", F.concat(F.lit("r"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("response"),
        (F.col("conv_id") * 100000 + F.col("turn")).alias("ord"),
    )
    return req.unionByName(again).select("conv_id", "turn", "key"), joins.first_per_key(entries, "ord").select("key", "response")


@query("joi06_cache_misses", _CACHE + " SELECT DISTINCT key FROM req ANTI JOIN cache USING (key)")
def _(spark, d):
    return joins.cache_misses(*requests_and_cache(spark, d))


@query(
    "joi06_cache_plan",
    _CACHE + " SELECT conv_id, turn, req.key, coalesce(response, '') AS response, response IS NOT NULL AS cache_hit FROM req LEFT JOIN cache USING (key)",
)
def _(spark, d):
    served = joins.serve_from_cache(*requests_and_cache(spark, d))
    return served.select("conv_id", "turn", "key", F.coalesce("response", F.lit("")).alias("response"), "cache_hit")


# --- run comparison ------------------------------------------------------------------
def two_runs(spark, d):
    """Two runs of the order table: the second loses some rows and changes others."""
    a = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit("t1").alias("observation_ts"))
    b = a.where("o_orderkey % 101 <> 5").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 53 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 67 == 2, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.lit("t2").alias("observation_ts"),
    )
    return a, b


_RUNS = """WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 53 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 67 = 2 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 101 <> 5),
diff AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_left' ELSE 'differs' END AS state,
  CASE WHEN b.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
       CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) END AS columns
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
  WHERE b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice)"""


@query("joi07_run_diff", _RUNS + " SELECT * FROM diff")
def _(spark, d):
    return compare.run_diff(*two_runs(spark, d), ["o_orderkey"])


@query(
    "joi07_diff_verdict",
    _RUNS + " SELECT count(*) AS differing_rows, count(*) = 0 AS identical, (SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM diff ORDER BY o_orderkey LIMIT 3)) AS examples FROM diff",
)
def _(spark, d):
    return compare.diff_verdict(compare.run_diff(*two_runs(spark, d), ["o_orderkey"]), ["o_orderkey"])


@query(
    "shp11_multiset_difference",
    "WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem), m AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R') SELECT * FROM l EXCEPT ALL SELECT * FROM m",
)
def _(spark, d):
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return compare.multiset_difference(li.drop("l_returnflag"), li.where("l_returnflag <> 'R'").drop("l_returnflag"))


@query(
    "shp11_symmetric_difference",
    _RUNS + """, x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, -1) AS o_totalprice, side, count(*) AS copies
    FROM (SELECT *, 'left' AS side FROM x UNION ALL SELECT *, 'right' FROM y) GROUP BY ALL""",
)
def _(spark, d):
    return compare.symmetric_difference(*two_runs(spark, d)).withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(-1.0)))


@query(
    "agg14_run_fingerprint",
    f"""WITH h AS (SELECT {seed_sql("o_orderkey || '|' || o_custkey || '|' || o_orderstatus")} AS h FROM orders)
    SELECT count(*) AS rows, CAST(sum(h::HUGEINT) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h""",
)
def _(spark, d):
    rows = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit("now").alias("observation_ts"))
    return readout.fingerprint(rows, compare.WALL_CLOCK)


@query(
    "shp10_union_batches",
    """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, 'none' AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def _(spark, d):
    a = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = v.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key")
    )
    return compare.union_batches(a, b).withColumn("segment", F.coalesce("segment", F.lit("none")))


@query("shp12_first_per_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = v.table(spark, d, "orders").withColumn("ord", F.col("o_orderkey"))
    return joins.first_per_key(o, "ord", "o_custkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("shp12_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, d):
    return compare.distinct_values(v.table(spark, d, "orders"), "o_orderpriority")


# --- analysis datasets ------------------------------------------------------------------
_ID = f"'{STUDY}' AS \"STUDYID\", '{STUDY}-' || subject AS \"USUBJID\""


def cohort_lists(spark, d):
    return v.cohort_cust(spark, d).withColumn("conditions", coerce.to_list(F.col("conditions_text")))


BUILDERS = {
    "DM": lambda spark, d: datasets.dm(cohort_lists(spark, d), STUDY),
    "EX": lambda spark, d: datasets.ex(trial_log(spark, d), STUDY, "investigational product"),
    "VS": lambda spark, d: datasets.vs(v.obs_events(spark, d), STUDY, {"SYSBP": ("y", "mmHg"), "LAT": ("latency", "ms"), "NONE": ("absent", "x")}),
    "AE": lambda spark, d: datasets.ae(v.ae_events(spark, d), STUDY),
    "ADSL": lambda spark, d: datasets.adsl(trial_log(spark, d), STUDY),
    "ADVS": lambda spark, d: datasets.advs(trial_log(spark, d), STUDY, {"SYSBP": ("y", "y_change"), "COMPOSITE": ("latency", None)}),
    "ADAE": lambda spark, d: datasets.adae(v.ae_events(spark, d), v.obs_events(spark, d), STUDY),
}


@query(
    "shp03_vs_dataset",
    sql(
        "obs_events",
        f"""SELECT {_ID}, epoch AS "EPOCH", 'SYSBP' AS "VSTESTCD", y AS "VSORRES", 'mmHg' AS "VSORRESU", CASE WHEN epoch = 0 THEN 'Y' ELSE '' END AS "VSBLFL" FROM obs_events
            UNION ALL SELECT {_ID}, epoch, 'LAT', latency, 'ms', CASE WHEN epoch = 0 THEN 'Y' ELSE '' END FROM obs_events""",
    ),
)
def _(spark, d):
    return BUILDERS["VS"](spark, d)


@query(
    "shp04_advs_dataset",
    sql(
        "trial",
        f"""SELECT {_ID}, 'SYSBP' AS "PARAMCD", y AS "AVAL", {r('y_change', 4)} AS "CHG", epoch AS "EPOCH" FROM trial
            UNION ALL SELECT {_ID}, 'COMPOSITE', latency, NULL, epoch FROM trial""",
    ),
)
def _(spark, d):
    return rounded(BUILDERS["ADVS"](spark, d), ["CHG"], 4)


@query(
    "shp05_dm_dataset",
    sql(
        "cohort_cust",
        f""", {_LIST_SQL} SELECT {_ID}, CAST(site AS VARCHAR) AS "SITEID", arm AS "ARM", upper(arm)[1:8] AS "ARMCD", age AS "AGE", sex AS "SEX", ancestry AS "RACE",
            {r('bmi')} AS "BMIBL", CAST(len(conditions) AS INTEGER) AS "COMORBN", cyp2d6 AS "CYP2D6", CASE WHEN hla_b THEN 'Y' ELSE 'N' END AS "HLAB5701" FROM list""",
    ),
)
def _(spark, d):
    return rounded(BUILDERS["DM"](spark, d), ["BMIBL"])


@query(
    "shp06_ex_dataset",
    sql("trial", f"""SELECT {_ID}, 'investigational product' AS "EXTRT", dose AS "EXDOSE", 'mg' AS "EXDOSU", epoch AS "EPOCH", time_hours AS "EXSTDTC" FROM trial WHERE dose > 0"""),
)
def _(spark, d):
    return BUILDERS["EX"](spark, d)


@query(
    "shp07_ae_dataset",
    sql(
        "ae_events",
        f"""SELECT {_ID}, term AS "AETERM", soc AS "AESOC", grade AS "AETOXGR", CASE WHEN serious THEN 'Y' ELSE 'N' END AS "AESER", relatedness AS "AEREL",
            source AS "AESOURCE", p AS "AEPREDP", epoch AS "AESTDTC" FROM ae_events""",
    ),
)
def _(spark, d):
    return BUILDERS["AE"](spark, d)


@query(
    "shp08_adsl_dataset",
    sql(
        "trial",
        f"""SELECT {_ID}, arm_label AS "TRT01P", arm_label AS "TRT01A", 'Y' AS "SAFFL", 'Y' AS "ITTFL", CASE WHEN discontinued THEN 'Y' ELSE 'N' END AS "DISCONFL",
            discontinuation_reason AS "DCSREAS" FROM eot""",
    ),
)
def _(spark, d):
    return BUILDERS["ADSL"](spark, d)


@query(
    "shp09_adae_dataset",
    sql(
        "ae_events",
        f"""SELECT {_ID}, 'Arm ' || upper(arm) AS "TRTA", term AS "AEDECOD", grade AS "AETOXGR", CASE WHEN epoch > 0 THEN 'Y' ELSE 'N' END AS "TRTEMFL",
            CASE WHEN serious THEN 'Y' ELSE 'N' END AS "AESER" FROM ae_events""",
    ),
)
def _(spark, d):
    return BUILDERS["ADAE"](spark, d)


# --- text ------------------------------------------------------------------------------------
_SHAPES = """
, s AS (SELECT 'e' || event_id AS answer_id, (event_id // 3) % 10 AS shape, CAST(1 + k % 5 AS INTEGER) AS g, event_type || '_' || (k // 20) AS term FROM ev)"""
_ADVICE = " OR ".join(f"contains(lower(text), '{p}')" for p in text.ADVICE_PHRASES)


def spread_answers(spark, d):
    """Parsing takes far longer than reading, so a few file splits would leave most cores idle: texts are dealt to all of them."""
    return v.answers(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "answer_id")


@query(
    "txt01_symptom_rows",
    sql(
        "answers",
        _SHAPES + """ SELECT answer_id, 1 AS position, term, CASE WHEN shape = 8 THEN 5 ELSE g END AS grade, CASE WHEN shape IN (0, 1, 5) THEN 'felt it' ELSE '' END AS verbatim
          FROM s WHERE shape IN (0, 1, 2, 3, 4, 5, 8)
        UNION ALL SELECT answer_id, 2, 'ache', 3, '' FROM s WHERE shape IN (0, 1, 5)
        UNION ALL SELECT answer_id, p, t, u.g, CASE WHEN p = 2 THEN t ELSE '' END FROM s,
          (VALUES (2, 'plain ache', 1), (4, 'quoted', 1), (5, '', 1)) u(p, t, g) WHERE shape = 4""",
    ),
)
def _(spark, d):
    return events.symptom_rows(spread_answers(spark, d), "answer_id")


@query(
    "txt01_answer_status",
    sql(
        "answers",
        _SHAPES + f""" SELECT answer_id, CASE WHEN shape IN (0, 1, 5) THEN 'poor' ELSE 'acceptable' END AS tolerability,
          CASE WHEN shape IN (0, 1, 5) THEN 'unsure' ELSE 'continue' END AS adherence_intent, shape IN (1, 2, 3) AS repaired,
          CASE shape WHEN 6 THEN 'safety filter' WHEN 7 THEN 'empty response' WHEN 9 THEN 'unparseable' ELSE '' END AS error FROM s
        UNION ALL SELECT 'c_' || conv_id || '_' || turn, 'acceptable', 'continue', false,
          CASE WHEN {_ADVICE} THEN 'safety filter' ELSE 'unparseable' END FROM conversations""",
    ),
)
def _(spark, d):
    return events.answer_status(spread_answers(spark, d), "answer_id")


_GRADE_TEXT = """CASE k % 9 WHEN 0 THEN ' Severe ' WHEN 1 THEN 'life threatening' WHEN 2 THEN 'grade ' || (k % 7) WHEN 3 THEN CAST(k / 10.0::DOUBLE AS VARCHAR) WHEN 4 THEN 'true'
  WHEN 5 THEN NULL WHEN 6 THEN 'Moderate' WHEN 7 THEN CAST(k AS VARCHAR) ELSE 'unknown' END"""


@query(
    "txt02_grade_coercion",
    sql(
        "ev",
        f""", t AS (SELECT event_id, lower(trim({_GRADE_TEXT})) AS t, k % 2 = 1 AS quoted FROM ev)
        SELECT event_id, CAST(CASE WHEN NOT quoted AND try_cast(t AS DOUBLE) IS NOT NULL THEN least(5, greatest(1, round_even(try_cast(t AS DOUBLE), 0)))
          WHEN t = 'severe' THEN 3 WHEN t = 'life threatening' THEN 4 WHEN t = 'moderate' THEN 2
          WHEN regexp_matches(t, '[1-5]') THEN CAST(regexp_extract(t, '[1-5]') AS INTEGER) ELSE 1 END AS INTEGER) AS grade FROM t""",
    ),
)
def _(spark, d):
    m = F.col("k") % 9
    raw = (
        F.when(m == 0, " Severe ").when(m == 1, "life threatening").when(m == 2, F.concat(F.lit("grade "), (F.col("k") % 7).cast("string")))
        .when(m == 3, (F.col("k") / 10.0).cast("string")).when(m == 4, "true").when(m == 6, "Moderate").when(m == 7, F.col("k").cast("string")).when(m == 8, "unknown")
    )
    return v._events(spark, d).select("event_id", text.coerce_grade(raw, F.col("k") % 2 == 1).alias("grade"))


@query("txt03_safety_phrases", sql("answers", f"SELECT answer_id, {_ADVICE} AS rejected FROM answers"))
def _(spark, d):
    return v.answers(spark, d).select("answer_id", text.gives_advice(F.col("text")).alias("rejected"))


@query("txt04_enum_normalisation", "SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') THEN lower(trim(o_orderpriority)) ELSE 'normal' END AS level FROM orders")
def _(spark, d):
    level = text.normalise_enum(F.col("o_orderpriority"), ("1-urgent", "2-high"), "normal")
    return v.table(spark, d, "orders").select("o_orderkey", level.alias("level"))


#: Protocol text: how an answer puts a term.
WORDING = {
    "headache": "I have a dull headache that started a few hours after the dose.",
    "nausea": "My stomach feels unsettled and I have little appetite.",
    "rash": "I noticed a red itchy patch on my forearm.",
}


@query(
    "txt05_rule_based_report",
    sql(
        "obs_events",
        """, p AS (SELECT subject, epoch, worst_grade, unnest([{'i': 0, 't': 'headache', 'p': (n_ae % 4) / 10.0::DOUBLE}, {'i': 1, 't': 'rash', 'p': (n_rows % 5) / 8.0::DOUBLE},
             {'i': 2, 't': 'dry_mouth', 'p': 0.2::DOUBLE}, {'i': 3, 't': 'nausea', 'p': (epoch % 3) / 4.0::DOUBLE}]) AS e FROM obs_events),
        k AS (SELECT subject, epoch, worst_grade, e.t AS t, row_number() OVER (PARTITION BY subject, epoch ORDER BY e.p DESC, e.i) AS i FROM p WHERE e.p >= 0.15),
        j AS (SELECT subject, epoch, string_agg('{"term":"' || t || '","ctcae_grade":' || greatest(1, least(5, worst_grade)) || ',"verbatim":"' ||
             CASE t WHEN 'headache' THEN 'I have a dull headache that started a few hours after the dose.' WHEN 'rash' THEN 'I noticed a red itchy patch on my forearm.'
               WHEN 'nausea' THEN 'My stomach feels unsettled and I have little appetite.' ELSE 'I have some dry mouth since the dose.' END || '"}', ',' ORDER BY i) AS s FROM k WHERE i <= 3 GROUP BY ALL)
        SELECT o.subject, o.epoch, '{"symptoms":[' || coalesce(j.s, '') || '],"overall_tolerability":"' || CASE WHEN j.s IS NULL THEN 'good' WHEN worst_grade <= 2 THEN 'acceptable' ELSE 'poor' END ||
          '","adherence_intent":"' || CASE WHEN worst_grade >= 4 THEN 'discontinue' WHEN worst_grade = 3 THEN 'unsure' ELSE 'continue' END || '","epoch":' || o.epoch || ',"source":"offline-heuristic"}' AS report
        FROM obs_events o LEFT JOIN j USING (subject, epoch)""",
    ),
)
def _(spark, d):
    probs = F.create_map(
        F.lit("headache"), (F.col("n_ae") % 4) / 10.0, F.lit("rash"), (F.col("n_rows") % 5) / 8.0, F.lit("dry_mouth"), F.lit(0.2), F.lit("nausea"), (F.col("epoch") % 3) / 4.0
    )
    report = text.rule_based_report(probs, F.col("worst_grade"), F.col("epoch"), wording=WORDING, source="offline-heuristic")
    return v.obs_events(spark, d).select("subject", "epoch", report.alias("report"))


@query(
    "txt06_error_class",
    sql(
        "ev",
        """SELECT event_id, CASE k % 6 WHEN 0 THEN 'permanent' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient' WHEN 3 THEN 'permanent'
           WHEN 4 THEN CASE WHEN event_type = 'error' THEN 'transient' ELSE 'permanent' END ELSE 'permanent' END AS kind FROM ev""",
    ),
)
def _(spark, d):
    m = F.col("k") % 6
    msg = (
        F.when(m == 0, "ThrottlingException: model is gone").when(m == 1, "Request was Throttled").when(m == 2, "HTTP 503 from host")
        .when(m == 3, "Unauthorized after timeout").when(m == 4, "odd failure").otherwise("AccessDenied 429")
    )
    return v._events(spark, d).select("event_id", text.error_class(msg, F.col("event_type") == "error").alias("kind"))
