"""Schema contract, casting, projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions import coerce, hashing, text
from epochwise.functions.numbers import rnd
from epochwise.operators import contract, screening
from epochwise.plans import views as v
from epochwise.plans.base import query, r
from epochwise.plans.views import sql

# --- PRJ-01 ----------------------------------------------------------------
_KNOWN = {
    "patient_id": ("subject", "CAST(subject AS VARCHAR)"),
    "cohort_id": ("cohort", "cohort"),
    "site_id": ("site", "CAST(site AS VARCHAR)"),
    "arm_id": ("arm", "arm"),
    "arm_label": ("arm_label", "arm_label"),
    "llm_model": ("model", "coalesce(model, '')"),
    "llm_provider": ("provider", "coalesce(provider, '')"),
    "adherence_intent": ("intent", "intent"),
    "epoch": ("epoch", "epoch"),
}
_BY_TYPE = {
    "double": ("y", "y"),
    "integer": ("n_ae", "CAST(n_ae AS INTEGER)"),
    "boolean": ("narrated", "narrated"),
    "long": ("tokens_in", "tokens_in"),
}


def _contract_pairs():
    for f in contract.schema_of(contract.OBSERVATIONS).fields:
        if f.name in _KNOWN:
            yield f.name, *_KNOWN[f.name]
        elif f.dataType.typeName() == "string":
            yield f.name, None, "''"
        else:
            yield f.name, *_BY_TYPE[f.dataType.typeName()]


@query(
    "prj01_contract",
    sql("obs_events", "SELECT " + ", ".join(f"{s} AS {n}" for n, _, s in _contract_pairs()) + " FROM obs_events"),
)
def _(spark, d):
    # all known columns arrive as text and out of order; unknown text columns are missing
    src = v.obs_events(spark, d)
    loose = src.select(*[F.col(c).cast("string").alias(n) for n, c, _ in reversed(list(_contract_pairs())) if c])
    return contract.enforce(loose, contract.OBSERVATIONS)


# --- PRJ-02 ----------------------------------------------------------------
@query(
    "prj02_tolerant_cast",
    sql(
        "cohort_cust",
        """SELECT subject, CASE WHEN age_text IS NULL OR age_text IN ('NaN', 'n/a') THEN 55.0::DOUBLE
                  ELSE CAST(try_cast(age_text AS DOUBLE) AS DOUBLE) END AS age,
             lower(trim(flag_text)) IN ('1', 'true', 'yes', 'y', 't') AS flag,
             coalesce(conditions_text, 'none') AS history FROM cohort_cust""",
    ),
)
def _(spark, d):
    return v.cohort_cust(spark, d).select(
        "subject",
        coerce.to_double(F.col("age_text"), coerce.COHORT_DEFAULTS["age"]).alias("age"),
        coerce.to_bool(F.col("flag_text")).alias("flag"),
        coerce.to_text(F.col("conditions_text"), "none").alias("history"),
    )


# --- PRJ-03 ----------------------------------------------------------------
_LIST_SQL = """list AS (
  SELECT *, CASE WHEN conditions_text IS NULL OR trim(conditions_text) = '' THEN []::VARCHAR[]
                 WHEN conditions_text LIKE '[%' THEN CAST(from_json(conditions_text, '["VARCHAR"]') AS VARCHAR[])
                 ELSE list_filter(list_transform(string_split(conditions_text, ','), lambda s: trim(s)), lambda s: s <> '') END AS conditions
  FROM cohort_cust)"""


@query(
    "prj03_parse_list",
    sql(
        "cohort_cust",
        f", {_LIST_SQL} SELECT subject, CAST(len(conditions) AS BIGINT) AS n_conditions, array_to_string(conditions, ';') AS conditions FROM list",
    ),
)
def _(spark, d):
    parsed = v.cohort_cust(spark, d).select("subject", coerce.to_list(F.col("conditions_text")).alias("items"))
    return parsed.select(
        "subject", F.size("items").cast("bigint").alias("n_conditions"), F.concat_ws(";", "items").alias("conditions")
    )


# --- PRJ-04 ----------------------------------------------------------------
@query(
    "prj04_bands_and_flags",
    sql(
        "cohort_cust",
        f""", {_LIST_SQL} SELECT subject, CASE WHEN age < 40 THEN '18-39' WHEN age < 60 THEN '40-59' ELSE '60+' END AS age_band,
            CAST(len(conditions) AS BIGINT) AS n_conditions, CASE WHEN cyp2d6 = 'PM' THEN 1.0 ELSE 0.0 END::DOUBLE AS poor_metaboliser,
            CASE WHEN hla_b THEN 1.0 ELSE 0.0 END::DOUBLE AS hla_b,
            CASE cyp2d6 WHEN 'PM' THEN 1.35 WHEN 'IM' THEN 1.175 WHEN 'NM' THEN 1.0 ELSE 0.825 END::DOUBLE AS multiplier FROM list""",
    ),
)
def _(spark, d):
    return v.cohort_cust(spark, d).select(
        "subject",
        coerce.age_band(F.col("age")).alias("age_band"),
        F.size(coerce.to_list(F.col("conditions_text"))).cast("bigint").alias("n_conditions"),
        coerce.flag(F.col("cyp2d6") == "PM").alias("poor_metaboliser"),
        coerce.flag(F.col("hla_b")).alias("hla_b"),
        coerce.exposure_multiplier(F.col("cyp2d6")).alias("multiplier"),
    )


# --- PRJ-05 ----------------------------------------------------------------
_WHERE = "epoch > 3 and arm = 'high' and worst_grade >= 2"


@query("prj05_filter_project", sql("obs_events", f"SELECT subject, epoch, y, worst_grade FROM obs_events WHERE {_WHERE}"))
def _(spark, d):
    return contract.select_where(v.obs_events(spark, d), _WHERE, "subject, epoch, y, unknown_column, worst_grade")


@query("prj05_match_count", sql("obs_events", f"SELECT count(*) AS matches FROM obs_events WHERE {_WHERE}"))
def _(spark, d):
    return contract.select_where(v.obs_events(spark, d), _WHERE).agg(F.count("subject").alias("matches"))


# --- PRJ-06 / 07 / 08 --------------------------------------------------------
@query(
    "prj06_stable_hash",
    "SELECT o_orderkey, sha256('run1|' || o_custkey || '|' || o_orderpriority)[1:16] AS id16, "
    "sha256(o_orderkey || '|' || o_orderstatus)[1:32] AS id32 FROM orders",
)
def _(spark, d):
    return v.table(spark, d, "orders").select(
        "o_orderkey",
        hashing.stable_hash("run1", F.col("o_custkey"), F.col("o_orderpriority")).alias("id16"),
        hashing.stable_hash(F.col("o_orderkey"), F.col("o_orderstatus"), length=32).alias("id32"),
    )


@query(
    "prj07_seeded_draw",
    """SELECT o_orderkey, CAST(('0x' || sha256('7|' || o_orderkey || '|draw')[1:16])::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS seed,
       CAST(('0x' || sha256('7|' || o_orderkey || '|draw')[1:16])::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT)::DOUBLE / 9223372036854775808.0::DOUBLE AS u
       FROM orders""",
)
def _(spark, d):
    key = (F.lit("7"), F.col("o_orderkey"), F.lit("draw"))
    return v.table(spark, d, "orders").select(
        "o_orderkey", hashing.stable_seed(*key).alias("seed"), hashing.uniform(*key).alias("u")
    )


@query("prj08_anonymised_reference", "SELECT c_custkey, sha256(c_name)[1:8] AS ref FROM customer")
def _(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", hashing.anonymised(F.col("c_name")).alias("ref"))


# --- PRJ-09 ----------------------------------------------------------------
@query(
    "prj09_template_render",
    sql(
        "cohort_cust",
        """, p AS (SELECT *, [(subject % 10) / 10.0::DOUBLE, (subject % 7) / 10.0::DOUBLE, 0.35::DOUBLE] AS ps FROM cohort_cust),
        t AS (SELECT *, list_max(ps) AS top_p, ['headache', 'rash', 'nausea'][list_position(ps, list_max(ps))] AS top_term FROM p),
        u AS (SELECT subject, top_term, 'Profile: age ' || CAST(age AS INTEGER) || ', ' || CASE WHEN sex = 'F' THEN 'female' ELSE 'male' END ||
          ', smoker ' || smoking || '. Arm ' || arm || '. Pressure ' || CAST(sbp AS INTEGER) || ', enzyme ' || CAST(alt AS INTEGER) ||
          '. Highest risk: ' || top_term || ' at ' || CAST(CAST(round_even(top_p * 100, 0) AS INTEGER) AS VARCHAR) || '%.' AS prompt FROM t)
        SELECT subject, prompt, top_term, sha256('persona|' || prompt)[1:16] AS prompt_hash,
               CAST(greatest(1, length(prompt) // 4) AS BIGINT) AS tokens FROM u""",
    ),
)
def _(spark, d):
    c = v.cohort_cust(spark, d)
    risk = F.create_map(
        F.lit("headache"), (F.col("subject") % 10) / 10.0, F.lit("rash"), (F.col("subject") % 7) / 10.0, F.lit("nausea"), F.lit(0.35)
    )
    top = c.withColumn("top", text.top_entry(risk))
    prompt = F.format_string(
        "Profile: age %d, %s, smoker %s. Arm %s. Pressure %d, enzyme %d. Highest risk: %s at %d%%.",
        F.col("age").cast("int"),
        F.when(F.col("sex") == "F", "female").otherwise("male"),
        "smoking",
        "arm",
        F.col("sbp").cast("int"),
        F.col("alt").cast("int"),
        F.col("top.key"),
        F.rint(F.col("top.value") * 100).cast("int"),
    )
    return top.select("subject", prompt.alias("prompt"), F.col("top.key").alias("top_term")).select(
        "subject",
        "prompt",
        "top_term",
        hashing.stable_hash("persona", F.col("prompt")).alias("prompt_hash"),
        text.token_estimate(F.col("prompt")).alias("tokens"),
    )


# --- PRJ-10 ----------------------------------------------------------------
@query(
    "prj10_subject_codes",
    sql(
        "cohort_cust",
        "SELECT 'STUDY-001-' || subject AS usubjid, upper(arm)[1:8] AS armcd, CASE WHEN hla_b THEN 'Y' ELSE 'N' END AS hla_flag FROM cohort_cust",
    ),
)
def _(spark, d):
    return v.cohort_cust(spark, d).select(
        coerce.subject_code("STUDY-001", F.col("subject")).alias("usubjid"),
        coerce.arm_code(F.col("arm")).alias("armcd"),
        coerce.yes_no(F.col("hla_b")).alias("hla_flag"),
    )


# --- PRJ-11 / 12 -------------------------------------------------------------
CRITERIA = screening.Criteria(
    exclude=("heart_failure", "stroke"), max_conditions=1, require_any=("diabetes", "asthma", "ckd", "gout", "obesity", "migraine"),
    exclude_markers=("slco1b1",), min_egfr=10.0,
)
_SCREEN_SQL = _LIST_SQL + """, screened AS (
  SELECT *, CASE WHEN age < 18 OR age > 75 THEN 'age_out_of_range' WHEN egfr < 10 THEN 'renal_impairment'
       WHEN alt > 90 THEN 'hepatic_impairment' WHEN len(conditions) > 1 AND conditions_text NOT LIKE '[%' THEN 'comorbidity_burden'
       WHEN len(list_intersect(conditions, ['heart_failure', 'stroke'])) > 0 THEN 'excluded_condition'
       WHEN len(list_intersect(conditions, ['diabetes', 'asthma', 'ckd', 'gout', 'obesity', 'migraine'])) = 0 THEN 'required_condition_absent'
       WHEN slco1b1 THEN 'excluded_genotype_slco1b1' ELSE '' END AS reason FROM list)"""
_SCREEN_SQL = _SCREEN_SQL.replace(" AND conditions_text NOT LIKE '[%'", "")


def screened_cohort(spark, d):
    c = v.cohort_cust(spark, d).withColumn("conditions", coerce.to_list(F.col("conditions_text")))
    return screening.screen(c, CRITERIA)


@query("prj11_screening", sql("cohort_cust", f", {_SCREEN_SQL} SELECT subject, reason, reason = '' AS enrolled FROM screened"))
def _(spark, d):
    return screened_cohort(spark, d).select("subject", "reason", "enrolled")


@query(
    "prj12_screen_failures",
    sql(
        "cohort_cust",
        f", {_SCREEN_SQL} SELECT subject, cohort, age, {r('egfr')} AS egfr, alt, reason, CAST(len(conditions) AS INTEGER) AS n_conditions FROM screened WHERE reason <> ''",
    ),
)
def _(spark, d):
    return screening.failures(screened_cohort(spark, d)).withColumn("egfr", rnd(F.col("egfr")))
