"""Arm-level summaries, trajectories, flow, audit, overview and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.functions import intervals
from epochwise.functions.hashing import stable_hash, stable_seed
from epochwise.functions.numbers import ratio, rnd
from epochwise.operators.ranks import range_row_number
from epochwise.operators.safety import arm_sizes


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def sd_or_zero(value: Column | str) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def arm_summary(log: DataFrame, events: DataFrame, changes: list[str], ratio_column: str, control: str) -> DataFrame:
    """Per-arm readout from one pass over the log and one over the events.

    ``log`` carries ``last_epoch``, ``responder`` and ``discontinued``; measures
    are taken on last-epoch rows, row counts on all rows.
    """
    end = F.col("epoch") == F.col("last_epoch")
    at_end = lambda c: F.when(end, F.col(c))
    subjects = log.groupBy("arm").agg(
        F.count_distinct(at_end("subject")).alias("n_subjects"),
        F.count(F.lit(1)).alias("n_observations"),
        *[F.avg(at_end(c)).alias(f"mean_{c}") for c in changes],
        *[sd_or_zero(at_end(c)).alias(f"sd_{c}") for c in changes],
        F.count(F.when(end & F.col("responder"), 1)).alias("responders"),
        F.avg(at_end(ratio_column)).alias(f"mean_{ratio_column}"),
        F.count(F.when(end & F.col("discontinued"), 1)).alias("discontinuations"),
    )
    worst = events.groupBy("arm", "subject").agg(F.max("grade").alias("g"), F.bool_or("serious").alias("s"))
    harms = worst.groupBy("arm").agg(
        F.count("subject").alias("with_event"),
        F.count(F.when(F.col("g") >= 3, 1)).alias("grade3"),
        F.count(F.when(F.col("s"), 1)).alias("serious"),
        F.count(F.when(F.col("g") >= 5, 1)).alias("grade5"),
    )
    rows = subjects.join(harms, "arm", "left").fillna(0, ["with_event", "grade3", "serious", "grade5"])
    n = F.col("n_subjects")
    responder_ci = intervals.wilson(F.col("responders"), n)
    grade3_ci = intervals.wilson(F.col("grade3"), n)
    return rows.where(n > 0).select(
        "arm",
        (F.col("arm") == control).alias("is_control"),
        "n_subjects",
        "n_observations",
        *[F.col(f"{k}_{c}") for c in changes for k in ("mean", "sd")],
        ratio(F.col("responders"), n).alias("responder_rate"),
        ratio(F.col("with_event"), n).alias("event_rate"),
        ratio(F.col("grade3"), n).alias("grade3_plus_rate"),
        ratio(F.col("serious"), n).alias("serious_rate"),
        ratio(F.col("grade5"), n).alias("grade5_rate"),
        f"mean_{ratio_column}",
        "discontinuations",
        rnd(responder_ci[0]).alias("responder_ci_low"),
        rnd(responder_ci[1]).alias("responder_ci_high"),
        rnd(grade3_ci[0]).alias("grade3_plus_ci_low"),
        rnd(grade3_ci[1]).alias("grade3_plus_ci_high"),
    )


def rate_with_interval(rows: DataFrame, by: list[str], hit: Column, confidence=0.95) -> DataFrame:
    """Hits, total, rate and score interval per group."""
    g = rows.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = intervals.wilson(F.col("hits"), F.col("n"), confidence)
    return g.select(*by, "hits", "n", ratio(F.col("hits"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def demographics(rows: DataFrame, age="age", sex="sex", measure="sbp", change="change", discontinued="discontinued") -> DataFrame:
    return rows.groupBy("arm").agg(
        F.count_distinct("subject").alias("n"),
        F.avg(age).alias("age_mean"),
        sd_or_zero(age).alias("age_sd"),
        (_share(F.col(sex) == "F") * 100).alias("female_pct"),
        F.avg(measure).alias("end_mean"),
        F.avg(change).alias("change_mean"),
        F.count(F.when(F.col(discontinued), 1)).alias("discontinued"),
    )


def dose_response(rows: DataFrame, value: str, z: float = 1.96) -> DataFrame:
    """Mean and interval per arm, ordered by nominal dose."""
    g = rows.groupBy("arm", "dose").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    low, high = intervals.mean_interval(F.col("n"), F.col("mean"), F.col("sd"), z)
    return g.where("n > 0").select("arm", "dose", "n", "mean", low.alias("ci_low"), high.alias("ci_high"))


def with_dose_trend(rows: DataFrame) -> DataFrame:
    """Unweighted slope and R-squared of arm means on dose, beside each arm row.

    The window covers the arm rows only.  Null with fewer than two doses.
    """
    all_arms = W.partitionBy(F.lit(1))
    doses = F.max("dose").over(all_arms) > F.min("dose").over(all_arms)
    flat = F.max("mean").over(all_arms) == F.min("mean").over(all_arms)
    return rows.select(
        "*",
        F.when(doses, F.regr_slope("mean", "dose").over(all_arms)).alias("trend_slope"),
        F.when(doses, F.when(flat, 0.0).otherwise(F.regr_r2("mean", "dose").over(all_arms))).alias("trend_r_squared"),
    )


def counts_json(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """One JSON object of key counts; the keys are categories already counted."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(n).alias("n"))))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias(name))


def participant_flow(log: DataFrame) -> DataFrame:
    """Enrolled, completed and discontinued subjects with the allocation map."""
    per = log.groupBy("arm", "subject").agg(F.bool_or("discontinued").alias("stopped"))
    arms = per.groupBy("arm").agg(F.count("subject").alias("n"), F.count(F.when(F.col("stopped"), 1)).alias("s"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("arm").alias("k"), F.col("n").alias("n"))))
    return arms.agg(
        F.sum("n").alias("enrolled"),
        (F.sum("n") - F.sum("s")).alias("completed"),
        F.sum("s").alias("discontinued"),
        F.to_json(F.map_from_entries(entries)).alias("allocation"),
    )


def quality_audit(log: DataFrame, narrated="narrated", error="error", model="model") -> DataFrame:
    """Rows, subjects, narrated and error shares, epochs and sorted model names."""
    rows = F.count(F.lit(1))
    told = F.count(F.when(F.col(narrated), 1))
    bad = F.count(F.when(F.coalesce(error, F.lit("")) != "", 1))
    return log.agg(
        rows.alias("rows"),
        F.count_distinct("subject").alias("subjects"),
        told.alias("narrated_rows"),
        F.coalesce(F.rint(ratio(told, rows) * 10000) / 100, F.lit(0.0)).alias("narrated_pct"),
        bad.alias("error_rows"),
        F.coalesce(F.rint(ratio(bad, rows) * 1000000) / 10000, F.lit(0.0)).alias("error_pct"),
        (F.max("epoch") + 1).cast("bigint").alias("epochs"),
        F.concat_ws(",", F.sort_array(F.collect_set(model))).alias("models"),
    )


def null_counts(log: DataFrame) -> DataFrame:
    """Columns that hold nulls, with their counts: one pass, then a tiny unpivot."""
    names = log.columns
    one = log.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    return one.unpivot([], names, "column", "nulls").where("nulls > 0")


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Counts, means, fractions and distinct cohorts of a screening cohort."""
    return cohort.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("age").alias("mean_age"),
        _share(F.col("sex") == "F").alias("female_fraction"),
        F.avg("bmi").alias("mean_bmi"),
        F.avg("sbp").alias("mean_sbp"),
        _share(F.col("cyp2d6") == "PM").alias("poor_metaboliser_fraction"),
        _share(F.col("hla_b")).alias("hla_b_fraction"),
        F.count_distinct("cohort").alias("cohorts"),
        F.count_distinct("site").alias("sites"),
    )


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """Count and share of each category; the total comes from the category rows."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(1)))))


#: Levels of the digest tree; with 1024 children a node they hold 1e15 rows.
DIGEST_LEVELS = 5


def cohort_digest(rows: DataFrame, text: Column, *order: str, bits: int = 10) -> DataFrame:
    """Order-sensitive digest of a whole table, as a tree of digests over rank positions.

    Leaves cover 2**``bits`` consecutive ranks in the order of ``order`` (any orderable types, nulls first, ties by text);
    each level hashes up to as many digests of the level below, so no task joins more texts.  The shape depends on the
    number of rows only: the same texts in the same order give the same digest whatever the keys' values.  A table that
    fits one leaf gives the plain digest of its joined texts; a null text counts as empty.  No rows give no row.
    """
    keys = [f"k{i}" for i in range(len(order))]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.coalesce(text, F.lit("")).alias("t"))
    ranked = range_row_number(named, [], [*keys, "t"], "rn")
    level = ranked.select((F.col("rn") - 1).alias("o"), "t")
    for i in range(DIGEST_LEVELS):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "|")
        whole = F.sha2(joined, 256)
        level = level.groupBy((F.shiftright("o", bits) if i < DIGEST_LEVELS - 1 else F.lit(0)).alias("b")).agg(
            (F.when(F.count(F.lit(1)) == 1, F.max("t")).otherwise(whole) if i else whole).alias("t")
        )
        level = level.select(F.col("b").alias("o"), "t")
    return level.select(F.substring("t", 1, 16).alias("digest"))


def fingerprint(rows: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Order-free fingerprint of a table's rows: count plus a sum of row hashes."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns if c not in ignore]
    h = stable_seed(*cols)
    return rows.select(h.alias("h")).agg(
        F.count("h").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def trajectories(log: DataFrame, measures: list[str], z: float = 1.96) -> DataFrame:
    """Mean, sd, n and band per measure, arm and epoch.

    All measures share one aggregate; the unpivot runs on its result.
    """
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}__mean"), sd_or_zero(m).alias(f"{m}__sd"), F.count(m).alias(f"{m}__n")]
    g = log.groupBy("arm", "epoch").agg(*aggs)
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__mean").alias("mean"), F.col(f"{m}__sd").alias("sd"), F.col(f"{m}__n").alias("n")) for m in measures])
    long = g.select("arm", "epoch", F.explode(packed).alias("s")).select("s.metric", "arm", "epoch", "s.mean", "s.sd", "s.n")
    half = F.lit(z) * F.col("sd") / F.sqrt(F.greatest(F.lit(1), F.col("n")))
    return long.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def event_heat(events: DataFrame, log: DataFrame, top: int = 8) -> DataFrame:
    """Share of each arm's subjects with a term, for the most frequent terms.

    The term list is bounded by its limit.
    """
    seen = events.select("term", "arm", "subject").distinct().groupBy("term", "arm").agg(F.count("subject").alias("n"))
    best = seen.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(top)
    cells = seen.join(F.broadcast(best), "term").join(arm_sizes(log), "arm")
    return cells.select("term", "arm", "total", (100.0 * F.col("n") / F.greatest(F.lit(1), F.col("n_subjects"))).alias("pct"))


def heat_table(cells: DataFrame, arms: list[str]) -> DataFrame:
    """Terms by arms; zero where an arm never saw the term."""
    return cells.groupBy("term", "total").pivot("arm", arms).agg(F.max("pct")).fillna(0.0, arms).orderBy(F.desc("total"), "term")


def grade_stack(events: DataFrame, log: DataFrame) -> DataFrame:
    """Event counts for grades 1 to 5 per arm, arms without events included."""
    counts = events.groupBy("arm").agg(*[F.count(F.when(F.col("grade") == g, 1)).alias(f"g{g}") for g in range(1, 6)])
    names = [f"g{g}" for g in range(1, 6)]
    return log.select("arm").distinct().join(counts, "arm", "left").fillna(0, names)


def events_by_term(events: DataFrame) -> DataFrame:
    return events.groupBy("arm", "term").agg(F.count(F.lit(1)).alias("n"), F.max("grade").alias("worst")).orderBy("arm", F.desc("n"), "term")


def exposure_at_end(log: DataFrame, epoch: int, measures: list[str]) -> DataFrame:
    return log.where(F.col("epoch") == epoch).groupBy("arm").agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])


def cross_tab(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).orderBy(a, b)


def histogram(rows: DataFrame, value: str, bins: int = 18) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed.

    The range is one aggregate row.  An empty range is widened by one.
    """
    v = F.col(value).cast("double")
    clean = rows.select(v.alias("v")).where("v is not null and not isnan(v)")
    lo, hi = F.min("v"), F.max("v")
    ends = clean.agg(lo.alias("lo"), F.when(hi <= lo, lo + 1.0).otherwise(hi).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int")
    ranged = clean.withColumn("e", ends.select(F.struct("lo", "hi")).scalar()).select("v", "e.lo", "e.hi")
    counted = ranged.groupBy(index.alias("bin"), "lo", width.alias("width")).agg(F.count("v").alias("n"))
    start = F.col("lo") + F.col("bin") * F.col("width")
    return counted.select("bin", start.alias("from"), (start + F.col("width")).alias("to"), "n")


def overview(summary: DataFrame, comparisons: DataFrame, rules: DataFrame, alerts: DataFrame, primary: str, change: str) -> DataFrame:
    """Headline figures as (metric, value) rows, from results already aggregated."""
    per_arm = F.array(
        F.struct(F.concat_ws("_", F.lit("change"), "arm").alias("metric"), rnd(F.col(f"mean_{change}"), 3).alias("value")),
        F.struct(F.concat_ws("_", F.lit("responder_rate"), "arm").alias("metric"), rnd(F.col("responder_rate"), 4).alias("value")),
        F.struct(F.concat_ws("_", F.lit("grade3_rate"), "arm").alias("metric"), rnd(F.col("grade3_plus_rate"), 4).alias("value")),
    )
    per_comparison = F.array(
        F.struct(F.concat(F.lit("effect_"), "arm", F.lit("_vs_"), "control_arm").alias("metric"), rnd(F.col("effect"), 4).alias("value")),
        F.struct(F.concat_ws("_", F.lit("p_value"), "arm").alias("metric"), rnd(F.col("p_value"), 6).alias("value")),
    )

    def total(df, metric, value):
        return df.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "value")

    long = total(summary, "n_subjects", F.coalesce(F.sum("n_subjects"), F.lit(0)))
    long = long.unionByName(total(rules, "stopping_rules_triggered", F.count(F.when(F.col("triggered"), 1))))
    long = long.unionByName(total(alerts, "safety_alerts", F.count(F.lit(1))))
    long = long.unionByName(summary.select(F.explode(per_arm).alias("s")).select("s.metric", "s.value"))
    chosen = comparisons.where(F.col("endpoint") == primary)
    return long.unionByName(chosen.select(F.explode(per_comparison).alias("s")).select("s.metric", "s.value"))


def verdict(comparisons: DataFrame, rules: DataFrame, primary: str | None) -> DataFrame:
    """HOLD if a rule fired; else PROCEED on the largest separated effect; else REVIEW.

    Any interval that excludes zero separates, whatever its side.  Without
    rows for the primary endpoint all comparisons count.
    """
    on_primary = F.col("endpoint") == F.lit(primary) if primary else F.lit(True)
    separated = F.coalesce((F.col("ci_high") < 0) | (F.col("ci_low") > 0), F.lit(False))
    row = F.struct("endpoint", "arm", "control_arm", "effect", "ci_low", "ci_high", "meets_mcid")

    def best(cond):
        return F.max_by(row, F.when(cond & separated, F.abs("effect")))

    def found(cond):
        return F.count(F.when(cond, 1)) > 0

    picked = comparisons.agg(
        F.when(found(on_primary), best(on_primary)).otherwise(best(F.lit(True))).alias("best"),
        F.when(found(on_primary), found(on_primary & separated)).otherwise(found(separated)).alias("any_separated"),
    )
    fired = rules.agg(F.count(F.when(F.col("triggered"), 1)).alias("fired"), F.count(F.lit(1)).alias("evaluated"))
    both = picked.withColumn("f", fired.select(F.struct("fired", "evaluated")).scalar()).select("best", "any_separated", "f.*")
    label = F.when(F.col("fired") > 0, "HOLD").when(F.col("any_separated"), "PROCEED").otherwise("REVIEW")
    return both.select(
        label.alias("verdict"),
        "fired",
        "evaluated",
        F.when(label == "PROCEED", F.col("best.arm")).alias("arm"),
        F.when(label == "PROCEED", F.col("best.endpoint")).alias("endpoint"),
        F.when(label == "PROCEED", F.col("best.effect")).alias("effect"),
        F.when(label == "PROCEED", F.col("best.meets_mcid")).alias("meets_mcid"),
    )
