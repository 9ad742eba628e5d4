"""Safety tables, alerts and stopping rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.functions import intervals, tails
from epochwise.functions.numbers import ratio
from epochwise.operators import longitudinal as lon
from epochwise.operators.multiplicity import benjamini_hochberg


@dataclass(frozen=True)
class Rule:
    rule_id: str
    metric: str
    threshold: float
    comparator: str = "greater_or_equal"
    action: str = "review"
    min_epoch: int = 0
    arms: tuple[str, ...] = ()


def arm_sizes(eot: DataFrame, arm="arm", subject="subject") -> DataFrame:
    return eot.select(arm, subject).distinct().groupBy(arm).agg(F.count(subject).alias("n_subjects"))


def event_counts(events: DataFrame, extra=()) -> DataFrame:
    """Per (arm, term) event and subject counts from one pass over the events.

    Subjects are reduced first, so distinct counts need no row expansion and a
    frequent term is combined on the map side.
    """
    keys = ["arm", "term"]
    grades = [F.count(F.when(F.col("grade") == g, 1)).alias(f"g{g}") for g in range(1, 6)]
    per_subject = events.groupBy(*keys, "subject").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("p"),
        F.count("p").alias("np"),
        F.max("grade").alias("worst"),
        F.bool_or("serious").alias("serious"),
        F.bool_or(F.col("source").isin("llm", "hybrid")).alias("reported"),
        *grades,
    )

    def subjects(cond):
        return F.count(F.when(cond, 1))

    return per_subject.groupBy(*keys).agg(
        F.sum("n").alias("n_events"),
        F.count("subject").alias("n_subjects_with_event"),
        subjects(F.col("worst") >= 3).alias("grade3_plus"),
        subjects(F.col("worst") >= 5).alias("grade5"),
        subjects(F.col("serious")).alias("serious"),
        subjects(F.col("reported")).alias("reported_subjects"),
        F.try_divide(F.sum("p"), F.sum("np")).alias("mean_probability"),
        *[F.sum(f"g{g}").alias(f"g{g}") for g in range(1, 6)],
    )


def grade_histogram(counts: list[str]):
    """JSON map of the non-zero grade counts, in grade order."""
    pairs = F.array(*[F.struct(F.lit(str(i + 1)).alias("grade"), F.col(c).alias("n")) for i, c in enumerate(counts)])
    return F.to_json(F.map_from_entries(F.filter(pairs, lambda x: x["n"] > 0)))


def main_class(events: DataFrame, by=("arm", "term"), value="soc") -> DataFrame:
    """Most frequent class per group; the smallest wins a tie."""
    return events.groupBy(*by).agg(F.coalesce(F.mode(value, True), F.lit("")).alias(value))


def safety_table(events: DataFrame, eot: DataFrame, control: str | None) -> DataFrame:
    """Arm x term safety rows; with a control arm also risk differences and tests.

    The adjustment family is all rows, the control arm's own rows included.
    """
    same = ["arm", "term"]
    classes = main_class(events).select(F.col("arm").alias("_a"), F.col("term").alias("_t"), "soc")
    counts = event_counts(events).join(
        classes, F.col("arm").eqNullSafe(F.col("_a")) & F.col("term").eqNullSafe(F.col("_t"))
    ).drop("_a", "_t")
    rows = counts.join(arm_sizes(eot), "arm").withColumn("rate", ratio(F.col("n_subjects_with_event"), F.col("n_subjects")))
    rows = rows.withColumn("grade_distribution", grade_histogram([f"g{g}" for g in range(1, 6)])).drop(*[f"g{g}" for g in range(1, 6)])
    if control is None:
        return rows
    size = eot.where(F.col("arm") == control).agg(F.count_distinct("subject"))
    rows = rows.withColumn("control_size", size.scalar())
    hits = F.max(F.when(F.col("arm") == control, F.col("n_subjects_with_event"))).over(W.partitionBy("term"))
    rows = rows.withColumn("control_hits", F.coalesce(F.when(F.col("term").isNotNull(), hits), F.lit(0)))
    has = F.coalesce(F.col("control_size") > 0, F.lit(False))
    low, high = intervals.newcombe(F.col("n_subjects_with_event"), F.col("n_subjects"), F.col("control_hits"), F.col("control_size"))
    p = tails.fisher_two_sided(
        "n_subjects_with_event", F.col("n_subjects") - F.col("n_subjects_with_event"), "control_hits", F.col("control_size") - F.col("control_hits")
    )
    rows = (
        rows.withColumn("control_rate", F.coalesce(ratio(F.col("control_hits"), F.col("control_size")), F.lit(0.0)))
        .withColumn("risk_difference", F.col("rate") - F.col("control_rate"))
        .withColumn("rd_ci_low", F.when(has, low))
        .withColumn("rd_ci_high", F.when(has, high))
        .withColumn("p_value", F.when(has, p))
    )
    return benjamini_hochberg(rows, "p_value", [], same).drop("control_hits", "control_size")


def by_rate(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("rate"), "term")


def safety_alerts(table: DataFrame, min_subjects=5) -> DataFrame:
    """Signals worth a look before the final analysis, with a message."""
    severe = (F.col("grade3_plus") > 0) & (F.col("q_value") < 0.10)
    common = (F.col("rate") > 0.25) & (F.col("risk_difference") > 0.10)
    severe = F.coalesce(severe, F.lit(False))

    def pct(value, digits):
        return F.format_string(f"%.{digits}f%%", value * 100)

    signed = F.concat(F.when(F.col("risk_difference") < 0, "-").otherwise("+"), pct(F.abs("risk_difference"), 1))
    message = F.when(
        severe,
        F.concat(
            F.col("term"), F.lit(": grade>=3 in "), F.col("grade3_plus").cast("string"), F.lit(" patients, rate difference "),
            signed, F.lit(" vs control (q="), F.format_string("%.3f", F.col("q_value")), F.lit(")"),
        ),
    ).otherwise(
        F.concat(F.col("term"), F.lit(": "), pct(F.col("rate"), 0), F.lit(" of patients affected vs "), pct(F.col("control_rate"), 0), F.lit(" in control"))
    )
    return table.where((F.col("n_subjects_with_event") >= min_subjects) & (severe | common)).select(
        F.when(severe & (F.col("grade3_plus") >= 3), "high").otherwise("moderate").alias("severity"), "term", "arm", message.alias("message")
    )


def rule_grid(log: DataFrame, rules: list[Rule], upto: int | None = None, arms: list[str] | None = None) -> DataFrame:
    """One row per rule, applicable arm and epoch from 0 to the last one.

    Arms and the last epoch come from one small aggregate of the log; rules are
    a literal array, so the expansion is arms x rules x epochs.
    """
    per_arm = log.groupBy("arm").agg(F.max("epoch").alias("_top"))
    last = F.max("_top").over(W.partitionBy(F.lit(1)))
    per_arm = per_arm.withColumn("_max", last if upto is None else F.least(last, F.lit(upto)))
    if arms is not None:
        per_arm = per_arm.where(F.col("arm").isin(*arms))
    entries = [
        F.struct(
            F.lit(x.rule_id).alias("rule_id"),
            F.lit(x.metric).alias("metric"),
            F.lit(float(x.threshold)).alias("threshold"),
            F.lit(x.comparator).alias("comparator"),
            F.lit(x.action).alias("action"),
            F.lit(x.min_epoch).alias("min_epoch"),
            F.array(*[F.lit(a) for a in x.arms]).cast("array<string>").alias("arms"),
        )
        for x in rules
    ]
    grid = per_arm.select("arm", "_max", F.explode(F.array(*entries)).alias("r")).select("arm", "_max", "r.*")
    grid = grid.where((F.size("arms") == 0) | F.array_contains("arms", F.col("arm"))).where(F.col("min_epoch") <= F.col("_max"))
    return grid.withColumn("epoch", F.explode(F.sequence("min_epoch", "_max"))).drop("_max", "arms", "min_epoch")


def first_hits(events: DataFrame, log: DataFrame | None = None, elevated_measure: str | None = None, fold=3.0, floor=100.0) -> DataFrame:
    """First qualifying epoch per metric, arm and subject."""
    kinds = {
        "grade3_plus_rate": F.col("grade") >= 3,
        "sae_rate": F.col("serious"),
        "mortality_rate": F.col("grade") >= 5,
    }
    wide = events.groupBy("arm", "subject").agg(*[F.min(F.when(c, F.col("epoch"))).alias(m) for m, c in kinds.items()])
    long = wide.unpivot(["arm", "subject"], list(kinds), "metric", "first_epoch").where("first_epoch is not null")
    if elevated_measure is not None:
        up = lon.elevated(log, log, elevated_measure, fold, floor)
        up = up.groupBy("arm", "subject").agg(F.min("epoch").alias("first_epoch")).withColumn("metric", F.lit("alt_elevation_rate"))
        long = long.unionByName(up)
    return long


def stopping_rules(
    log: DataFrame, events: DataFrame, rules: list[Rule], upto: int | None = None, elevated_measure: str | None = None, fold=3.0, floor=100.0
) -> DataFrame:
    """Evaluate every rule per arm and epoch.

    Numerator: subjects with a qualifying event up to the epoch.  Denominator:
    subjects observed at the epoch.  Each subject contributes its first hit
    only, so the cumulative distinct count is a running sum over epochs.
    """
    hits = first_hits(events, log, elevated_measure, fold, floor)
    per_epoch = hits.groupBy("metric", "arm", F.greatest(F.col("first_epoch"), F.lit(0)).alias("epoch")).agg(F.count("subject").alias("new_hits"))
    at_risk = log.select("arm", "epoch", "subject").distinct().groupBy("arm", "epoch").agg(F.count("subject").alias("n_at_risk"))
    return evaluate(per_epoch, at_risk, rules, upto)


def evaluate(per_epoch: DataFrame, at_risk: DataFrame, rules: list[Rule], upto: int | None = None) -> DataFrame:
    """Turn per-epoch first-hit counts into rule evaluations.

    The grid of arms and epochs comes from the at-risk counts, not from the log.
    """
    # the running sum starts at epoch 0, below a rule's own first epoch
    start = {x.rule_id: x.min_epoch for x in rules}
    full = rule_grid(at_risk, [Rule(x.rule_id, x.metric, x.threshold, x.comparator, x.action, 0, x.arms) for x in rules], upto)
    run = W.partitionBy("rule_id", "arm").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    counted = full.join(per_epoch, ["metric", "arm", "epoch"], "left").withColumn("hits", F.sum(F.coalesce("new_hits", F.lit(0))).over(run))
    first = F.create_map(*[F.lit(v) for kv in start.items() for v in kv])[F.col("rule_id")]
    rows = counted.where(F.col("epoch") >= first).join(at_risk, ["arm", "epoch"])
    observed = ratio(F.col("hits"), F.col("n_at_risk"))
    fires = F.when(F.col("comparator") == "greater_than", observed > F.col("threshold")).otherwise(observed >= F.col("threshold"))
    return rows.select("rule_id", "epoch", "arm", "metric", observed.alias("observed"), "threshold", "comparator", fires.alias("triggered"), "action", "n_at_risk")
