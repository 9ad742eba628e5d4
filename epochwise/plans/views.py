"""Trial-shaped views over the driver tables, in Spark and as SQL text.

Raw tables may hold a hot customer or user with a large share of all rows, so
each per-subject view first aggregates to (subject, calendar period).  After
that a subject owns at most one row per epoch, and per-subject windows are
bounded by the number of epochs in the calendar instead of by row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.functions.hashing import stable_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# V1: orders as an observation log
# --------------------------------------------------------------------------
def obs_orders(spark: SparkSession, d: str) -> DataFrame:
    """subject x half-year log: x = mean root price, y = largest root price."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    monthly = (
        table(spark, d, "orders")
        .select(F.col("o_custkey").alias("subject"), month.alias("m"), F.sqrt("o_totalprice").alias("v"))
        .groupBy("subject", "m")
        .agg(F.sum("v").alias("s"), F.max("v").alias("top"), F.count("v").alias("n"))
    )
    first = F.min("m").over(W.partitionBy("subject"))
    per_epoch = (
        monthly.withColumn("epoch", F.floor((F.col("m") - first) / 6).cast("int"))
        .groupBy("subject", "epoch")
        .agg(
            (F.sum("s") / F.sum("n")).alias("x"),
            F.max("top").alias("y"),
            F.sum("n").alias("n_orders"),
        )
    )
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("arm"), F.col("c_nationkey").alias("site")
    )
    return per_epoch.join(cust, "subject").select("subject", "arm", "site", "epoch", "x", "y", "n_orders")


OBS_ORDERS = """
obs_orders AS (
  WITH o AS (SELECT o_custkey AS subject, year(o_orderdate) * 12 + month(o_orderdate) AS m,
                    sqrt(o_totalprice) AS v FROM orders),
       f AS (SELECT subject, min(m) AS m0 FROM o GROUP BY subject)
  SELECT o.subject, c.c_mktsegment AS arm, c.c_nationkey AS site,
         CAST((o.m - f.m0) // 6 AS INTEGER) AS epoch,
         avg(o.v) AS x, max(o.v) AS y, count(*) AS n_orders
  FROM o JOIN f USING (subject) JOIN customer c ON c.c_custkey = o.subject
  GROUP BY ALL
)"""


# --------------------------------------------------------------------------
# V3: events as adverse events, one per subject, day and term
# --------------------------------------------------------------------------
_DAY0 = "2024-01-01"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("subject"),
        F.col("event_type"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.datediff(F.col("ts"), F.lit(_DAY0)).alias("epoch"),
        F.element_at(F.array(F.lit("ctl"), F.lit("low"), F.lit("high")), (F.col("user_id") % 3 + 1).cast("int")).alias("arm"),
    )


def ae_events(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    term = F.concat_ws("_", F.col("event_type"), F.floor(F.col("k") / 4).cast("string"))
    g = (
        e.groupBy("subject", "arm", "epoch", term.alias("term"))
        .agg(F.max("k").alias("k"))
        .withColumn("grade", (1 + F.col("k") % 5).cast("int"))
    )
    return g.select(
        stable_hash(F.col("subject"), F.col("epoch"), F.col("term"), length=20).alias("ae_id"),
        "subject",
        "arm",
        "epoch",
        "term",
        F.concat(F.lit("soc_"), (F.col("k") % 3).cast("string")).alias("soc"),
        "grade",
        (F.col("grade") >= 4).alias("serious"),
        F.when(F.col("k") > 66, "probable").when(F.col("k") > 33, "possible").otherwise("unlikely").alias("relatedness"),
        (F.col("k") / 100.0).alias("p"),
        F.when(F.col("k") % 16 == 0, "hybrid").when(F.col("k") % 8 == 0, "llm").otherwise("model").alias("source"),
        F.when(F.col("k") % 3 == 0, F.concat_ws(" ", F.lit("felt"), F.col("term"))).otherwise("").alias("verbatim"),
    )


EV = """
ev AS (
  SELECT event_id, ts, user_id AS subject, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
         CASE user_id % 3 WHEN 0 THEN 'ctl' WHEN 1 THEN 'low' ELSE 'high' END AS arm
  FROM events
)"""

AE_EVENTS = """
ae_events AS (
  WITH g AS (SELECT subject, arm, epoch, event_type || '_' || (k // 4) AS term, max(k) AS k
             FROM ev GROUP BY ALL)
  SELECT sha256(subject || '|' || epoch || '|' || term)[1:20] AS ae_id, subject, arm, epoch, term,
         'soc_' || (k % 3) AS soc, CAST(1 + k % 5 AS INTEGER) AS grade, k % 5 >= 3 AS serious,
         CASE WHEN k > 66 THEN 'probable' WHEN k > 33 THEN 'possible' ELSE 'unlikely' END AS relatedness,
         k / 100.0::DOUBLE AS p,
         CASE WHEN k % 16 = 0 THEN 'hybrid' WHEN k % 8 = 0 THEN 'llm' ELSE 'model' END AS source,
         CASE WHEN k % 3 = 0 THEN 'felt ' || term ELSE '' END AS verbatim
  FROM g
)"""


# --------------------------------------------------------------------------
# V2: events as an observation log with missing baselines
# --------------------------------------------------------------------------
def obs_events(spark: SparkSession, d: str) -> DataFrame:
    """subject x day log with doses, grades, narration fields and withdrawals."""
    e = _events(spark, d)
    ae = 1 + F.col("k") % 5
    view = F.col("event_type") == "view"
    g = e.groupBy("subject", "arm", "epoch").agg(
        F.avg(F.sqrt("value")).alias("x"),
        F.max("value").alias("y"),
        F.count("event_id").alias("n_rows"),
        F.coalesce(F.max(ae), F.lit(0)).cast("int").alias("worst_grade"),
        F.count(ae).alias("n_ae"),
        F.bool_or(view).alias("narrated"),
        F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("k"))), F.lit(0)).alias("pk"),
        F.coalesce(F.sum(F.when(view, F.col("k"))), F.lit(0)).cast("bigint").alias("tokens_in"),
        F.coalesce(F.sum(F.when(view, F.col("k") % 7)), F.lit(0)).cast("bigint").alias("tokens_out"),
        F.coalesce(F.max(F.when(view, F.col("value"))), F.lit(0.0)).alias("latency"),
        F.coalesce(F.bool_or(view & (F.col("k") % 2 == 0)), F.lit(False)).alias("cache_hit"),
        F.coalesce(F.bool_or(view & (F.col("k") >= 97)), F.lit(False)).alias("failed"),
    )
    dose = F.when(F.col("arm") == "low", 50.0).when(F.col("arm") == "high", 150.0).otherwise(0.0)
    return g.select(
        "subject",
        "arm",
        F.concat(F.lit("Arm "), F.upper("arm")).alias("arm_label"),
        (F.col("subject") % 7).cast("int").alias("site"),
        F.concat(F.lit("C"), F.lpad((F.col("subject") % 11).cast("string"), 3, "0")).alias("cohort"),
        "epoch",
        (F.col("epoch") * 12.0).alias("time_hours"),
        F.when(F.col("epoch") > 0, dose).otherwise(0.0).alias("dose"),
        "x",
        "y",
        "n_rows",
        "worst_grade",
        "n_ae",
        "narrated",
        F.when(F.col("pk") >= 95, "discontinue").when(F.col("pk") >= 80, "unsure").otherwise("continue").alias("intent"),
        "tokens_in",
        "tokens_out",
        "latency",
        "cache_hit",
        F.when(F.col("failed"), "timeout").otherwise("").alias("error"),
        F.when(F.col("narrated"), F.concat(F.lit("m"), (F.col("subject") % 2).cast("string"))).alias("model"),
        F.when(F.col("narrated"), F.concat(F.lit("prov"), (F.col("subject") % 3).cast("string"))).alias("provider"),
    )


OBS_EVENTS = """
obs_events AS (
  WITH g AS (
    SELECT subject, arm, epoch, avg(sqrt(value)) AS x, max(value) AS y, count(*) AS n_rows,
           CAST(coalesce(max(1 + k % 5), 0) AS INTEGER) AS worst_grade,
           count(k) AS n_ae, bool_or(event_type = 'view') AS narrated,
           coalesce(max(k) FILTER (event_type = 'purchase'), 0) AS pk,
           CAST(coalesce(sum(k) FILTER (event_type = 'view'), 0) AS BIGINT) AS tokens_in,
           CAST(coalesce(sum(k % 7) FILTER (event_type = 'view'), 0) AS BIGINT) AS tokens_out,
           coalesce(max(value) FILTER (event_type = 'view'), 0.0) AS latency,
           bool_or(event_type = 'view' AND k % 2 = 0) AS cache_hit,
           bool_or(event_type = 'view' AND k >= 97) AS failed
    FROM ev GROUP BY ALL)
  SELECT subject, arm, 'Arm ' || upper(arm) AS arm_label, CAST(subject % 7 AS INTEGER) AS site,
         'C' || lpad(CAST(subject % 11 AS VARCHAR), 3, '0') AS cohort, epoch, epoch * 12.0::DOUBLE AS time_hours,
         CASE WHEN epoch > 0 AND arm = 'low' THEN 50.0 WHEN epoch > 0 AND arm = 'high' THEN 150.0 ELSE 0.0 END::DOUBLE AS dose,
         x, y, n_rows, worst_grade, n_ae, narrated,
         CASE WHEN pk >= 95 THEN 'discontinue' WHEN pk >= 80 THEN 'unsure' ELSE 'continue' END AS intent,
         tokens_in, tokens_out, latency, cache_hit, CASE WHEN failed THEN 'timeout' ELSE '' END AS error,
         CASE WHEN narrated THEN 'm' || (subject % 2) END AS model,
         CASE WHEN narrated THEN 'prov' || (subject % 3) END AS provider
  FROM g
)"""


# --------------------------------------------------------------------------
# V4: lineitem as a dose study
# --------------------------------------------------------------------------
def dose_lines(spark: SparkSession, d: str) -> DataFrame:
    dose = F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("d"), F.lpad(dose.cast("string"), 2, "0")).alias("arm"),
        dose.cast("double").alias("dose"),
        F.sqrt("l_extendedprice").alias("response"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("responder"),
        F.col("l_orderkey").alias("subject"),
    )


DOSE_LINES = """
dose_lines AS (
  SELECT 'd' || lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 2, '0') AS arm,
         CAST(round(l_discount * 100) AS DOUBLE) AS dose, sqrt(l_extendedprice) AS response,
         l_quantity AS quantity, l_returnflag = 'R' AS responder, l_orderkey AS subject
  FROM lineitem
)"""


# --------------------------------------------------------------------------
# V5: customers as a screening cohort, with untidy text columns
# --------------------------------------------------------------------------
CONDITIONS = [
    "hypertension", "diabetes", "asthma", "heart_failure", "ckd", "copd", "obesity",
    "arthritis", "migraine", "anaemia", "gout", "stroke", "depression",
]


def cohort_cust(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in CONDITIONS])
    one = F.element_at(names, (key % 13 + 1).cast("int"))
    two = F.element_at(names, (key % 7 + 1).cast("int"))
    text = (
        F.when(key % 4 == 0, F.concat(F.lit('["'), one, F.lit('", "'), two, F.lit('"]')))
        .when(key % 4 == 1, F.concat(one, F.lit(" , "), two, F.lit(",")))
        .when(key % 4 == 2, one)
        .when(key % 20 == 3, F.lit("[]"))
        .when(key % 20 == 7, F.lit("  "))
        .when(key % 20 == 11, F.lit("42"))
    )
    age = 18 + key % 70
    weight = (50 + key % 61).cast("double")
    height = (150 + key % 45).cast("double")
    return c.select(
        key.alias("subject"),
        F.concat(F.lit("C"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("cohort"),
        F.col("n_nationkey").alias("site"),
        F.col("n_regionkey").alias("region"),
        F.col("c_mktsegment").alias("arm"),
        age.cast("double").alias("age"),
        F.when(key % 11 == 0, "NaN").when(key % 13 == 0, "n/a").when(key % 17 != 0, age.cast("string")).alias("age_text"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("true", "YES", " y ", "0", "no", "T")]), (key % 6 + 1).cast("int")
        ).alias("flag_text"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        weight.alias("weight"),
        height.alias("height"),
        (weight / (height / 100.0 * height / 100.0)).alias("bmi"),
        (F.col("c_acctbal") / 100.0).alias("egfr"),
        (10 + (key * 7) % 100).cast("double").alias("alt"),
        (0.5 + (key % 30) / 20.0).alias("creatinine"),
        (110 + key % 50).cast("double").alias("sbp"),
        text.alias("conditions_text"),
        F.element_at(F.array(*[F.lit(x) for x in ("AFR", "AMR", "EAS", "EUR", "SAS")]), F.col("n_regionkey") + 1).alias("ancestry"),
        F.element_at(F.array(*[F.lit(x) for x in ("PM", "IM", "NM", "UM")]), (key % 4 + 1).cast("int")).alias("cyp2d6"),
        (key % 19 == 0).alias("hla_b"),
        (key % 9 == 0).alias("slco1b1"),
        F.element_at(F.array(*[F.lit(x) for x in ("never", "former", "current")]), (key % 3 + 1).cast("int")).alias("smoking"),
    )


_SQL_CONDITIONS = "[" + ", ".join(f"'{x}'" for x in CONDITIONS) + "]"
COHORT_CUST = f"""
cohort_cust AS (
  WITH b AS (SELECT *, c_custkey AS key, {_SQL_CONDITIONS}[c_custkey % 13 + 1] AS one,
                    {_SQL_CONDITIONS}[c_custkey % 7 + 1] AS two
             FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT key AS subject, 'C' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS cohort, n_nationkey AS site,
         n_regionkey AS region, c_mktsegment AS arm, CAST(18 + key % 70 AS DOUBLE) AS age,
         CASE WHEN key % 11 = 0 THEN 'NaN' WHEN key % 13 = 0 THEN 'n/a' WHEN key % 17 <> 0
              THEN CAST(18 + key % 70 AS VARCHAR) END AS age_text,
         ['true', 'YES', ' y ', '0', 'no', 'T'][key % 6 + 1] AS flag_text,
         CASE WHEN key % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CAST(50 + key % 61 AS DOUBLE) AS weight,
         CAST(150 + key % 45 AS DOUBLE) AS height,
         CAST(50 + key % 61 AS DOUBLE) / (CAST(150 + key % 45 AS DOUBLE) / 100.0::DOUBLE * CAST(150 + key % 45 AS DOUBLE) / 100.0::DOUBLE) AS bmi,
         c_acctbal / 100.0::DOUBLE AS egfr, CAST(10 + (key * 7) % 100 AS DOUBLE) AS alt,
         0.5::DOUBLE + (key % 30) / 20.0::DOUBLE AS creatinine, CAST(110 + key % 50 AS DOUBLE) AS sbp,
         CASE WHEN key % 4 = 0 THEN '["' || one || '", "' || two || '"]'
              WHEN key % 4 = 1 THEN one || ' , ' || two || ',' WHEN key % 4 = 2 THEN one
              WHEN key % 20 = 3 THEN '[]' WHEN key % 20 = 7 THEN '  ' WHEN key % 20 = 11 THEN '42' END AS conditions_text,
         ['AFR', 'AMR', 'EAS', 'EUR', 'SAS'][n_regionkey + 1] AS ancestry,
         ['PM', 'IM', 'NM', 'UM'][key % 4 + 1] AS cyp2d6, key % 19 = 0 AS hla_b, key % 9 = 0 AS slco1b1,
         ['never', 'former', 'current'][key % 3 + 1] AS smoking
  FROM b
)"""


# --------------------------------------------------------------------------
# V6: events as trace spans (at most 64 spans to a trace)
# --------------------------------------------------------------------------
def spans_events(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    pos = F.col("event_id") % 64
    parent = (
        F.when(F.col("event_id") % 97 == 0, F.lit("lost"))
        .when(pos > 0, F.concat(F.lit("s"), (F.col("event_id") - pos + F.floor(pos / 2)).cast("string")))
        .otherwise("")
    )
    return e.select(
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 64).cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"),
        parent.alias("parent_id"),
        F.concat(F.lit("step_"), F.col("event_type")).alias("name"),
        F.when(F.col("event_type").isin("view", "click", "error"), "LLM").otherwise("CHAIN").alias("kind"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.col("value").alias("duration_ms"),
        F.col("k").alias("tokens_in"),
        (F.col("k") % 13).alias("tokens_out"),
        (F.col("k") % 4 == 0).alias("cache_hit"),
        F.concat(F.lit("prov"), (F.col("k") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("model"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
        F.create_map(
            F.lit("run_id"), F.concat(F.lit("run"), (F.col("subject") % 5).cast("string")),
            F.lit("epoch"), F.col("epoch").cast("string"),
        ).alias("attributes"),
    )


SPANS_EVENTS = """
spans_events AS (
  SELECT 't' || (event_id // 64) AS trace_id, 's' || event_id AS span_id,
         CASE WHEN event_id % 97 = 0 THEN 'lost'
              WHEN event_id % 64 > 0 THEN 's' || (event_id - event_id % 64 + (event_id % 64) // 2) ELSE '' END AS parent_id,
         'step_' || event_type AS name,
         CASE WHEN event_type IN ('view', 'click', 'error') THEN 'LLM' ELSE 'CHAIN' END AS kind,
         ts AS start_time, value AS duration_ms, k AS tokens_in, k % 13 AS tokens_out, k % 4 = 0 AS cache_hit,
         'prov' || (k % 3) AS provider, 'm' || (k % 2) AS model,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
         'run' || (subject % 5) AS run_id, CAST(epoch AS VARCHAR) AS epoch_text
  FROM ev
)"""


# --------------------------------------------------------------------------
# V7: the dimension hierarchy as lineage edges
# --------------------------------------------------------------------------
def edges_dim(spark: SparkSession, d: str) -> DataFrame:
    def node(kind: str, c: str):
        return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def rows(df, source, target, relation, agent):
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(agent).alias("agent"))

    return (
        rows(table(spark, d, "nation"), node("region", "n_regionkey"), node("nation", "n_nationkey"), "splits", "loader")
        .unionByName(rows(table(spark, d, "supplier"), node("nation", "s_nationkey"), node("supplier", "s_suppkey"), "hosts", "vendor"))
        .unionByName(rows(table(spark, d, "customer"), node("nation", "c_nationkey"), node("customer", "c_custkey"), "hosts", "sales"))
        .unionByName(rows(table(spark, d, "orders"), node("customer", "o_custkey"), node("order", "o_orderkey"), "places", "sales"))
    )


EDGES_DIM = """
edges_dim AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'splits' AS relation, 'loader' AS agent FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'hosts', 'vendor' FROM supplier
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'hosts', 'sales' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'places', 'sales' FROM orders
)"""


# --------------------------------------------------------------------------
# V8: yearly batches of orders, and their log
# --------------------------------------------------------------------------
def order_batches(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        (year - 1994).cast("int").alias("_version"),
        stable_hash(year, length=8).alias("run_id"),
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
    )


def batch_log(spark: SparkSession, d: str) -> DataFrame:
    return (
        order_batches(spark, d)
        .groupBy(F.col("_version").alias("version"), "run_id")
        .agg(F.count("o_orderkey").alias("rows"))
        .select(
            "version",
            F.concat(F.lit("2024-01-"), F.lpad(F.col("version").cast("string"), 2, "0")).alias("written_at"),
            "run_id",
            F.when(F.col("version") == 4, "overwrite").otherwise("append").alias("mode"),
            "rows",
        )
    )


BATCHES = """
order_batches AS (
  SELECT CAST(year(o_orderdate) - 1994 AS INTEGER) AS _version, sha256(CAST(year(o_orderdate) AS VARCHAR))[1:8] AS run_id,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
),
batch_log AS (
  SELECT _version AS version, '2024-01-' || lpad(CAST(_version AS VARCHAR), 2, '0') AS written_at, run_id,
         CASE WHEN _version = 4 THEN 'overwrite' ELSE 'append' END AS mode, count(*) AS rows
  FROM order_batches GROUP BY ALL
)"""


# --------------------------------------------------------------------------
# V9: free-text answers, eight shapes, plus the conversations as plain prose
# --------------------------------------------------------------------------
def answers(spark: SparkSession, d: str) -> DataFrame:
    """One answer per event; the shape cycles with event_id."""
    e = _events(spark, d)
    g = (1 + F.col("k") % 5).cast("string")
    term = F.concat_ws("_", F.col("event_type"), F.floor(F.col("k") / 20).cast("string"))
    obj = F.concat(
        F.lit('{"symptoms": [{"term": "'), term, F.lit('", "ctcae_grade": '), g,
        F.lit(', "verbatim": "felt it"}, {"symptom": "ache", "grade": "severe"}], "overall_tolerability": " Poor ", "adherence_intent": "unsure"}'),
    )
    shape = F.floor(F.col("event_id") / 3) % 10
    text = (
        F.when(shape == 0, obj)
        .when(shape == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit('{"symptoms": [{"term": "'), term, F.lit('", "ctcae_grade": '), g, F.lit(",},],}")))
        .when(shape == 3, F.concat(F.lit("{'symptoms': [{'term': '"), term, F.lit("', 'ctcae_grade': "), g, F.lit("}], 'note': None}")))
        .when(shape == 4, F.concat(F.lit('[{"name": "'), term, F.lit('", "grade": "'), g, F.lit(' of 5"}, "plain ache", 7, {"name": "quoted", "grade": "10"}, ""]')))
        .when(shape == 5, F.concat(F.lit("Well, "), obj, F.lit(" that is all.")))
        .when(shape == 6, F.concat(F.lit("You should take rest. "), obj))
        .when(shape == 7, F.lit("  "))
        .when(shape == 8, F.concat(F.lit('{"term": "'), term, F.lit('", "grade": 9.6}')))
        .otherwise(F.concat(F.lit("no complaints from user "), F.col("subject").cast("string")))
    )
    from_events = e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("answer_id"), "subject", "epoch", text.alias("text")
    )
    prose = table(spark, d, "conversations").select(
        F.concat_ws("_", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        F.col("conv_id").alias("subject"),
        F.col("turn").cast("int").alias("epoch"),
        "text",
    )
    return from_events.unionByName(prose)


ANSWERS = """
answers AS (
  WITH b AS (SELECT *, CAST(1 + k % 5 AS VARCHAR) AS g, event_type || '_' || (k // 20) AS term, (event_id // 3) % 10 AS shape
             FROM ev),
       o AS (SELECT *, '{"symptoms": [{"term": "' || term || '", "ctcae_grade": ' || g ||
             ', "verbatim": "felt it"}, {"symptom": "ache", "grade": "severe"}], "overall_tolerability": " Poor ", "adherence_intent": "unsure"}' AS obj FROM b)
  SELECT 'e' || event_id AS answer_id, subject, epoch,
         CASE shape WHEN 0 THEN obj WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```'
           WHEN 2 THEN '{"symptoms": [{"term": "' || term || '", "ctcae_grade": ' || g || ',},],}'
           WHEN 3 THEN '{''symptoms'': [{''term'': ''' || term || ''', ''ctcae_grade'': ' || g || '}], ''note'': None}'
           WHEN 4 THEN '[{"name": "' || term || '", "grade": "' || g || ' of 5"}, "plain ache", 7, {"name": "quoted", "grade": "10"}, ""]'
           WHEN 5 THEN 'Well, ' || obj || ' that is all.' WHEN 6 THEN 'You should take rest. ' || obj
           WHEN 7 THEN '  ' WHEN 8 THEN '{"term": "' || term || '", "grade": 9.6}'
           ELSE 'no complaints from user ' || subject END AS text
  FROM o
  UNION ALL
  SELECT 'c_' || conv_id || '_' || turn, conv_id, CAST(turn AS INTEGER), text FROM conversations
)"""

_SQL = {
    "obs_orders": [OBS_ORDERS],
    "ev": [EV],
    "ae_events": [EV, AE_EVENTS],
    "obs_events": [EV, OBS_EVENTS],
    "dose_lines": [DOSE_LINES],
    "cohort_cust": [COHORT_CUST],
    "spans_events": [EV, SPANS_EVENTS],
    "edges_dim": [EDGES_DIM],
    "batches": [BATCHES],
    "answers": [EV, ANSWERS],
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """Put the CTEs of the named views in front of ``body``.

    ``body`` starts with ``SELECT`` or with ``, name AS (...)`` further CTEs.
    """
    parts: list[str] = []
    for v in views.split():
        for p in _SQL[v]:
            if p not in parts:
                parts.append(p)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + body.strip()
