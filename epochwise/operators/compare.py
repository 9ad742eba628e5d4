"""Run-to-run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that only record wall-clock time.
WALL_CLOCK = ("observation_ts", "llm_latency_ms")


def comparable(rows: DataFrame, ignore=WALL_CLOCK) -> DataFrame:
    return rows.select(*sorted(c for c in rows.columns if c not in ignore))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those in ``b``, with multiplicity."""
    return a.exceptAll(b)


def symmetric_difference(a: DataFrame, b: DataFrame, ignore=WALL_CLOCK) -> DataFrame:
    """Rows on one side only, with how many more copies that side has.

    One grouped pass over both runs: copies are combined before the shuffle,
    so a row repeated many times costs one record per map task.
    """
    left, right = comparable(a, ignore), comparable(b, ignore)
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    net = both.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("copies", F.abs("_n")).drop("_n")


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], ignore=WALL_CLOCK) -> DataFrame:
    """Per key: missing side or the differing columns (null-safe comparison)."""
    cols = [c for c in a.columns if c not in keys and c not in ignore]
    left = a.select(*keys, F.struct(*cols).alias("l"))
    right = b.select(*keys, F.struct(*cols).alias("r"))
    both = left.join(right, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in cols]))
    state = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.size(changed) > 0, "differs")
    return both.select(*keys, state.alias("state"), F.when(state == "differs", F.concat_ws(",", changed)).otherwise("").alias("columns")).where(
        "state is not null"
    )


def diff_verdict(diff: DataFrame, keys: list[str], examples: int = 3) -> DataFrame:
    """Number of differing rows with a few example keys."""
    total = diff.agg(F.count(F.lit(1)))
    shown = diff.orderBy(*keys).limit(examples).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *keys))), ";").alias("examples"))
    return shown.withColumn("differing_rows", total.scalar()).withColumn("identical", F.col("differing_rows") == 0)


def distinct_values(rows: DataFrame, c: str) -> DataFrame:
    return rows.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def union_batches(*frames: DataFrame) -> DataFrame:
    """Concatenate by name; a column missing from a batch is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
