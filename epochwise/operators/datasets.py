"""Standard analysis datasets derived from an observation log and its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.functions.coerce import arm_code, subject_code, yes_no
from epochwise.operators.longitudinal import end_of_treatment

# Dataset -> variable -> label.
VARIABLES = {
    "DM": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "SITEID": "Study site identifier",
        "ARM": "Planned arm",
        "ARMCD": "Planned arm code",
        "AGE": "Age at enrolment (years)",
        "SEX": "Sex",
        "RACE": "Ancestry group (synthetic)",
        "BMIBL": "Baseline BMI (kg/m2)",
        "COMORBN": "Number of baseline comorbidities",
        "CYP2D6": "CYP2D6 metaboliser phenotype (synthetic)",
        "HLAB5701": "HLA-B*57:01 carrier status (synthetic)",
    },
    "EX": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "EXTRT": "Name of study treatment",
        "EXDOSE": "Dose administered (mg)",
        "EXDOSU": "Dose units",
        "EPOCH": "Simulated dosing epoch",
        "EXSTDTC": "Simulated start of dose (hours from first dose)",
    },
    "VS": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "EPOCH": "Simulated epoch",
        "VSTESTCD": "Vital signs test code",
        "VSORRES": "Result",
        "VSORRESU": "Result units",
        "VSBLFL": "Baseline flag",
    },
    "AE": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "AETERM": "Reported term for the adverse event",
        "AESOC": "System organ class",
        "AETOXGR": "CTCAE grade",
        "AESER": "Serious event flag",
        "AEREL": "Causality",
        "AESOURCE": "Origin of the report (model, llm, hybrid)",
        "AEPREDP": "Model-predicted probability",
        "AESTDTC": "Simulated onset epoch",
    },
    "ADSL": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "TRT01P": "Planned treatment",
        "TRT01A": "Actual treatment",
        "SAFFL": "Safety population flag",
        "ITTFL": "Intention-to-treat flag",
        "DISCONFL": "Discontinued from treatment flag",
        "DCSREAS": "Reason for discontinuation",
    },
    "ADVS": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "PARAMCD": "Parameter code",
        "AVAL": "Analysis value",
        "CHG": "Change from baseline",
        "EPOCH": "Simulated epoch",
    },
    "ADAE": {
        "STUDYID": "Study identifier",
        "USUBJID": "Unique subject identifier",
        "TRTA": "Actual treatment",
        "AEDECOD": "Dictionary-derived term",
        "AETOXGR": "CTCG grade",
        "TRTEMFL": "Treatment-emergent flag",
        "AESER": "Serious flag",
    },
}


def _ids(study: str, subject="subject"):
    return [F.lit(study).alias("STUDYID"), subject_code(study, F.col(subject)).alias("USUBJID")]


def dm(cohort: DataFrame, study: str) -> DataFrame:
    """Demographics, one row per subject; ``conditions`` is an array column."""
    return cohort.select(
        *_ids(study),
        F.col("site").cast("string").alias("SITEID"),
        F.col("arm").alias("ARM"),
        arm_code(F.col("arm")).alias("ARMCD"),
        F.col("age").alias("AGE"),
        F.col("sex").alias("SEX"),
        F.col("ancestry").alias("RACE"),
        F.col("bmi").alias("BMIBL"),
        F.size("conditions").alias("COMORBN"),
        F.col("cyp2d6").alias("CYP2D6"),
        yes_no(F.col("hla_b")).alias("HLAB5701"),
    )


def ex(log: DataFrame, study: str, treatment: str) -> DataFrame:
    """Exposure: dosed rows only."""
    return log.where(F.coalesce("dose", F.lit(0.0)) > 0).select(
        *_ids(study),
        F.lit(treatment).alias("EXTRT"),
        F.col("dose").alias("EXDOSE"),
        F.lit("mg").alias("EXDOSU"),
        F.col("epoch").alias("EPOCH"),
        F.col("time_hours").alias("EXSTDTC"),
    )


def vs(log: DataFrame, study: str, tests: dict[str, tuple[str, str]]) -> DataFrame:
    """Vital signs, long: ``tests`` maps code -> (column, unit); one pass over the log."""
    have = set(log.columns)
    entries = [
        F.struct(F.lit(code).alias("code"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit"))
        for code, (c, unit) in tests.items()
        if c in have
    ]
    long = log.select("subject", "epoch", F.explode(F.array(*entries)).alias("t"))
    return long.select(
        *_ids(study),
        F.col("epoch").alias("EPOCH"),
        F.col("t.code").alias("VSTESTCD"),
        F.col("t.value").alias("VSORRES"),
        F.col("t.unit").alias("VSORRESU"),
        F.when(F.col("epoch") == 0, "Y").otherwise("").alias("VSBLFL"),
    )


def ae(events: DataFrame, study: str) -> DataFrame:
    return events.select(
        *_ids(study),
        F.col("term").alias("AETERM"),
        F.col("soc").alias("AESOC"),
        F.col("grade").alias("AETOXGR"),
        yes_no(F.col("serious")).alias("AESER"),
        F.col("relatedness").alias("AEREL"),
        F.col("source").alias("AESOURCE"),
        F.col("p").alias("AEPREDP"),
        F.col("epoch").alias("AESTDTC"),
    )


def adsl(log: DataFrame, study: str) -> DataFrame:
    """Subject level at the last epoch, with disposition."""
    return end_of_treatment(log).select(
        *_ids(study),
        F.col("arm_label").alias("TRT01P"),
        F.col("arm_label").alias("TRT01A"),
        F.lit("Y").alias("SAFFL"),
        F.lit("Y").alias("ITTFL"),
        yes_no(F.col("discontinued")).alias("DISCONFL"),
        F.coalesce("discontinuation_reason", F.lit("")).alias("DCSREAS"),
    )


def advs(log: DataFrame, study: str, params: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Analysis values with changes; a parameter without a change column has null."""
    entries = [
        F.struct(
            F.lit(code).alias("code"),
            F.col(c).cast("double").alias("aval"),
            (F.col(chg) if chg else F.lit(None)).cast("double").alias("chg"),
        )
        for code, (c, chg) in params.items()
        if c in log.columns
    ]
    long = log.select("subject", "epoch", F.explode(F.array(*entries)).alias("p"))
    return long.select(
        *_ids(study), F.col("p.code").alias("PARAMCD"), F.col("p.aval").alias("AVAL"), F.col("p.chg").alias("CHG"), F.col("epoch").alias("EPOCH")
    )


def adae(events: DataFrame, log: DataFrame, study: str) -> DataFrame:
    """Events with the subject's first arm label and a treatment-emergent flag."""
    label = log.groupBy("subject").agg(F.min_by("arm_label", "epoch").alias("label"))
    return events.join(label, "subject", "left").select(
        *_ids(study),
        F.coalesce("label", F.lit("")).alias("TRTA"),
        F.col("term").alias("AEDECOD"),
        F.col("grade").alias("AETOXGR"),
        yes_no(F.coalesce("epoch", F.lit(0)) > 0).alias("TRTEMFL"),
        yes_no(F.col("serious")).alias("AESER"),
    )
