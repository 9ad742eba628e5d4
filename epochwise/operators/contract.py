"""Fixed table contracts: column order, types, null policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

# The observation log, in order.
OBSERVATIONS = (
    "observation_id string, sim_run_id string, protocol_id string, protocol_version string, patient_id string, "
    "cohort_id string, site_id string, arm_id string, arm_label string, epoch int, time_hours double, dose_mg double, "
    "plasma_conc_mg_l double, auc_epoch_mg_h_l double, cumulative_exposure double, sbp double, dbp double, hr double, "
    "qtc_ms double, alt_u_l double, ast_u_l double, creatinine_mg_dl double, egfr double, sbp_change double, "
    "dbp_change double, hr_change double, biomarker_composite double, responder boolean, worst_ctcae_grade int, "
    "n_adverse_events int, adverse_events_json string, symptoms_json string, symptom_summary string, "
    "discontinued boolean, discontinuation_reason string, adherence_intent string, llm_used boolean, "
    "llm_provider string, llm_model string, llm_latency_ms double, llm_tokens_in int, llm_tokens_out int, "
    "llm_cache_hit boolean, llm_attempts int, llm_error string, prompt_hash string, physiology_model_version string, "
    "physiology_backend string, rng_seed bigint, observation_ts string"
)

# The cohort table, in order.
COHORT = (
    "patient_id string, cohort_id string, site_id string, arm_id string, enrolled boolean, age double, sex string, "
    "weight_kg double, height_cm double, bmi double, baseline_sbp double, baseline_dbp double, baseline_hr double, "
    "egfr double, alt_u_l double, ast_u_l double, creatinine_mg_dl double, comorbidities_json string, "
    "concomitant_meds_json string, medical_history string, smoking string, alcohol_units_week double, "
    "ancestry string, cyp2d6 string, cyp3a4 string, hla_b_57_01 boolean, hla_dq2_2 boolean, "
    "adrb1_arg389gly boolean, ace_dd boolean, slco1b1_decreased boolean"
)

# The adverse-event table, in order.
EVENTS = (
    "ae_id string, patient_id string, arm_id string, epoch int, term string, soc string, ctcae_grade int, "
    "serious boolean, relatedness string, predicted_probability double, source string, reported_verbatim string"
)


_SCALARS = {
    "string": StringType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "boolean": BooleanType(),
}


def schema_of(columns: str) -> StructType:
    """Schema of a ``name type, name type`` contract; needs no running session."""
    pairs = (item.split() for item in columns.split(","))
    return StructType([StructField(name, _SCALARS[kind]) for name, kind in pairs])


def enforce(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Project to the contract: its order, its types, null text as ``''``.

    Contract columns the source lacks are added as null (text: ``''``); columns
    outside the contract are dropped, so the scan reads only what is needed.
    Unreadable values become null instead of failing the job.
    """
    schema = schema_of(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    out = []
    for f in schema.fields:
        value = F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, StringType):
            value = F.coalesce(value, F.lit(""))
        out.append(value.alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema_of(schema) if isinstance(schema, str) else schema)


def declared_subset(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Encode every struct, array and map column as JSON text; scalars stay.

    Map entries are put in key order first, so equal maps give equal text.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, MapType):
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        elif isinstance(f.dataType, StructType):
            c = F.to_json(F.struct(*[c[n].alias(n) for n in sorted(f.dataType.names)]))
        elif isinstance(f.dataType, ArrayType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def select_where(df: DataFrame, where: str | None = None, columns: str | None = None) -> DataFrame:
    """Filter by expression text, then keep the listed columns that exist."""
    if where:
        df = df.where(F.expr(where))
    if columns:
        df = declared_subset(df, [c.strip() for c in columns.split(",") if c.strip()])
    return df


def preview(df: DataFrame, limit: int) -> DataFrame:
    """First rows of a query result, for display."""
    return df.limit(limit)
