"""Per-subject sequence operators over an observation log.

The log holds one row per (subject, epoch).  Windows here are partitioned by
subject, so each group is bounded by the number of epochs in the design, never
by the number of raw rows: ``one_row_per_epoch`` aggregates a raw table (with
map-side combine, so a hot subject collapses before the shuffle) to that shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.functions.hashing import uniform

# Reasons recorded for a withdrawal.
REASON_CONSENT = "patient withdrew consent after reported symptoms"
REASON_GRADE = "CTCAE grade %d adverse event"


def one_row_per_epoch(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates)


def with_last_epoch(log: DataFrame, subject="subject", epoch="epoch", name="last_epoch") -> DataFrame:
    return log.withColumn(name, F.max(epoch).over(W.partitionBy(subject)))


def end_of_treatment(log: DataFrame, subject="subject", epoch="epoch") -> DataFrame:
    """Rows of each subject's last epoch; rows tied on it are all kept."""
    return with_last_epoch(log, subject, epoch, "_last").where(F.col(epoch) == F.col("_last")).drop("_last")


def change_from_baseline(log: DataFrame, measures: list[str], subject="subject", epoch="epoch") -> DataFrame:
    """Add ``<m>_base``, ``<m>_change`` and ``<m>_ratio``, without a join.

    Null where the subject has no epoch 0; the ratio is null on a zero baseline.
    """
    w = W.partitionBy(subject)
    log = log.withColumns({f"{m}_base": F.max(F.when(F.col(epoch) == 0, F.col(m))).over(w) for m in measures})
    extra = []
    for m in measures:
        extra.append((F.col(m) - F.col(f"{m}_base")).alias(f"{m}_change"))
        extra.append(F.try_divide(F.col(m), F.col(f"{m}_base")).alias(f"{m}_ratio"))
    return log.select("*", *extra)


def attach_baseline(rows: DataFrame, log: DataFrame, measures: list[str], how="left", subject="subject", epoch="epoch") -> DataFrame:
    """Join form of the baseline attach: epoch-0 values of ``log`` beside ``rows``."""
    base = log.where(F.col(epoch) == 0).select(subject, *[F.col(m).alias(f"{m}_base") for m in measures])
    return rows.join(base, subject, how)


def elevated(rows: DataFrame, log: DataFrame, measure: str, fold: float, floor: float, subject="subject", epoch="epoch", upto=None) -> DataFrame:
    """Rows at least ``fold`` times the subject's baseline and above ``floor``."""
    if upto is not None:
        rows = rows.where(F.col(epoch) <= upto)
    both = attach_baseline(rows, log, [measure], "inner", subject, epoch)
    return both.where((F.col(measure) >= fold * F.col(f"{measure}_base")) & (F.col(measure) > floor))


def meets_threshold(value: Column, direction: str, threshold: float) -> Column:
    """Is the value on the beneficial side of the threshold?"""
    if direction == "decrease":
        return value <= threshold
    if direction == "increase":
        return value >= threshold
    return F.abs(value) >= abs(threshold)


def responder(value: Column, at_evaluation: Column, direction: str, threshold: float | None = None, mcid: float | None = None) -> Column:
    """Responder flag, true only on the evaluation row.

    Without an explicit threshold the minimal important difference decides,
    signed by the direction.
    """
    if threshold is None:
        size = abs(mcid or 0.0)
        threshold = -size if direction == "decrease" else size
    return F.coalesce(at_evaluation & meets_threshold(value, direction, threshold), F.lit(False))


def propagate_discontinuation(
    log: DataFrame, subject="subject", epoch="epoch", grade="worst_grade", narrated="narrated", intent="intent", dose="dose", stop_grade=4
) -> DataFrame:
    """Flag the first withdrawal row and all later ones; dose is 0 afterwards."""
    w = W.partitionBy(subject)
    by_grade = F.col(grade) >= stop_grade
    by_intent = F.col(narrated) & (F.col(intent) == "discontinue")
    trigger = (F.col(epoch) > 0) & (by_grade | by_intent)
    reason = F.when(by_grade, F.format_string(REASON_GRADE, F.col(grade))).otherwise(REASON_CONSENT)
    first = F.min(F.when(trigger, F.struct(F.col(epoch).alias("at"), reason.alias("why")))).over(w)
    flagged = F.coalesce(F.col(epoch) >= F.col("_first.at"), F.lit(False))
    after = F.coalesce(F.col(epoch) > F.col("_first.at"), F.lit(False))
    made = {
        "discontinued": flagged,
        "discontinuation_reason": F.when(flagged, F.col("_first.why")).otherwise(""),
        dose: F.when(after, 0.0).otherwise(F.col(dose)),
    }
    return log.withColumn("_first", first).withColumns(made).drop("_first")


def cumulative(log: DataFrame, measure: str, name: str, subject="subject", epoch="epoch") -> DataFrame:
    """Running total of ``measure`` along the epochs of each subject."""
    w = W.partitionBy(subject).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn(name, F.sum(measure).over(w))


def sample_for_review(
    log: DataFrame, seed: str, mode="triggered", trigger_grade=3, rate=0.1, budget=6, subject="subject", epoch="epoch", grade="worst_grade"
) -> DataFrame:
    """Pick subject-epochs for narration: never epoch 0, at most ``budget`` per subject."""
    draw = uniform(seed, F.col(subject), F.col(epoch), "sample") < rate
    pick = {"all": F.lit(True), "triggered": (F.col(grade) >= trigger_grade) | draw, "sample": draw}[mode]
    chosen = log.where((F.col(epoch) > 0) & pick)
    rank = F.row_number().over(W.partitionBy(subject).orderBy(epoch))
    return chosen.withColumn("pick", rank).where(F.col("pick") <= budget)


def deviations(log: DataFrame, first_only=False, subject="subject", cohort="cohort", arm="arm", epoch="epoch") -> DataFrame:
    """Flagged rows with their reason: one per flagged epoch, or the first only."""
    rows = log.where("discontinued").select(subject, cohort, arm, epoch, F.col("discontinuation_reason").alias("reason"))
    if first_only:
        rows = rows.groupBy(subject, cohort, arm).agg(F.min(epoch).alias(epoch), F.min_by("reason", epoch).alias("reason"))
    return rows


def scheduled_dose(arms: DataFrame, log: DataFrame, hours: float, arm="arm", epoch="epoch", route="oral") -> DataFrame:
    """Dose, time and instruction of each row under per-arm titration.

    ``arms`` comes from the protocol document (arm, base_dose, start_epoch,
    step, max_dose, is_control), so it is broadcast.
    """
    steps = F.col(epoch) - F.col("start_epoch") + 1
    raised = F.col("base_dose") + F.col("step") * steps
    capped = F.least(raised, F.coalesce(F.col("max_dose"), raised))
    titrated = F.when(F.col("start_epoch").isNotNull() & (F.col(epoch) >= F.col("start_epoch")), capped).otherwise(F.col("base_dose"))
    dose = F.when(F.col(epoch) <= 0, 0.0).otherwise(titrated)
    shown = F.regexp_replace(F.format_string("%.2f", F.col("planned_dose")), r"\.?0+$", "")
    return (
        log.join(F.broadcast(arms), arm, "left")
        .withColumn("planned_dose", F.bround(dose, 6))
        .withColumn("planned_time", F.col(epoch) * F.lit(float(hours)))
        .withColumn(
            "instruction",
            F.when(F.col("is_control"), "withhold study drug (placebo arm)").otherwise(
                F.concat(F.lit("administer "), shown, F.lit(" mg "), F.lit(route.upper()))
            ),
        )
        .drop("base_dose", "start_epoch", "step", "max_dose", "is_control")
    )


def ordered(log: DataFrame, *keys: str) -> DataFrame:
    """Total output order by range partitioning; no single-task sort."""
    return log.orderBy(*keys)
