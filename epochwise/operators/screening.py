"""Eligibility screening: ordered rules, first failing reason wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criteria:
    min_age: float = 18.0
    max_age: float = 75.0
    min_egfr: float = 50.0
    max_alt: float = 90.0
    max_conditions: int = 5
    exclude: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    exclude_markers: tuple[str, ...] = field(default=())


def failure_reason(c: Criteria, age="age", egfr="egfr", alt="alt", conditions="conditions") -> Column:
    """Name of the first rule a subject fails; ``''`` when all hold."""

    def texts(values):
        return F.array(*[F.lit(v) for v in values])

    cond = F.col(conditions)
    reason = (
        F.when(~F.col(age).between(c.min_age, c.max_age), "age_out_of_range")
        .when(F.col(egfr) < c.min_egfr, "renal_impairment")
        .when(F.col(alt) > c.max_alt, "hepatic_impairment")
        .when(F.size(cond) > c.max_conditions, "comorbidity_burden")
    )
    if c.exclude:
        reason = reason.when(F.arrays_overlap(cond, texts(c.exclude)), "excluded_condition")
    if c.require_any:
        reason = reason.when(~F.arrays_overlap(cond, texts(c.require_any)), "required_condition_absent")
    for marker in c.exclude_markers:
        reason = reason.when(F.col(marker), f"excluded_genotype_{marker}")
    return reason.otherwise("")


def screen(df: DataFrame, c: Criteria, **names: str) -> DataFrame:
    """Add ``reason`` and ``enrolled``; a narrow projection, no shuffle."""
    return df.withColumn("reason", failure_reason(c, **names)).withColumn("enrolled", F.col("reason") == "")


def enrolled(screened: DataFrame) -> DataFrame:
    return screened.where("reason = ''")


def failures(screened: DataFrame, keep=("subject", "cohort", "age", "egfr", "alt"), conditions="conditions") -> DataFrame:
    return screened.where("reason <> ''").select(*keep, "reason", F.size(conditions).alias("n_conditions"))


def screening_summary(screened: DataFrame) -> DataFrame:
    """Screened, enrolled and failed counts with one JSON map of reasons."""
    per = screened.groupBy("reason").agg(F.count("reason").alias("n"))
    failed = F.sum(F.when(F.col("reason") != "", F.col("n")).otherwise(0))
    return per.agg(
        F.sum("n").alias("screened"),
        F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("n"))), F.lit(0)).alias("enrolled"),
        failed.alias("screen_failures"),
        F.bround(failed / F.sum("n"), 4).alias("screen_failure_rate"),
        # one entry per rule name, so the array is bounded by the rule list
        F.to_json(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(F.col("reason") != "", F.struct("reason", "n"))))
            )
        ).alias("failure_reasons"),
    )
