"""Row numbers, ranks and order statistics that never sit in one task.

A plain ranking window over a hot group puts that whole group into one task.
These forms split a group into blocks along the order, count the blocks (small
rows), turn the counts into offsets, and rank only inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.operators.joins import hot_split_join
from epochwise.session import cut_lineage


def block_row_number(df: DataFrame, group: list[str], order: list[str], block: Column, name="rn", total: str | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)``, split by ``block``.

    ``total`` also adds the group's row count under that name.  ``block`` is a deterministic expression that never decreases along
    ``order`` (a key range such as ``floor(id / 4096)``, or a text prefix).
    The unit of work is one block; the window over block counts sees one row
    per block.
    """
    df = df.withColumn("_block", block)
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    sizes = df.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(before))
    offsets = offsets.drop("_n")
    inside = F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order))
    return (
        df.join(offsets, [*group, "_block"]).withColumn(name, (inside + F.col("_offset")).cast("bigint")).drop("_block", "_offset")
    )


def range_row_number(df: DataFrame, group: list[str], order: list[str], name="rn", total: str | None = None, parts: int | None = None) -> DataFrame:
    """:func:`block_row_number` for keys of any orderable type and any spacing.

    Splitters are sampled from the order itself (Spark's range partitioning by group and key), so a group that holds all
    rows, or keys with a common prefix, spread over the ranges; each range is counted once and lower ranges are added up.
    The dealt rows are checkpointed, so ranges stay the same for count and numbering.  Rows with equal keys share a range.
    """
    by = [*group, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    ranged = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    return block_row_number(ranged, group, order, F.col("_range"), name, total).drop("_range")


SMALL_SIDE_ROWS = 100_000


def small_side(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Materialise an aggregate, and broadcast it only if its row count allows.

    Larger results keep the ordinary shuffled join.
    """
    kept = cut_lineage(df, arrow_rows)
    few = kept.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS
    return F.broadcast(kept) if few else kept


def ordered_bits(value: str) -> Column:
    """64-bit pattern of a double as a signed number of the same order; both zeros are one, NaN is largest."""
    bits = F.expr(f"cast(java_method('java.lang.Double', 'doubleToLongBits', {value} + 0.0D) AS bigint)")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


#: Bits that one round of the selection reads.
DIGIT = 16


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column], group: list[str]) -> DataFrame:
    """Exact order statistics per group, one column per entry of ``ranks``.

    A rank is a 1-based expression in ``n``, the group's count of non-null values.  Radix selection on the order-preserving
    bit pattern: each of four rounds counts the next 16 bits of the values that share the digits chosen so far, for all
    ranks at once.  A task sends at most 2^16 counters for each prefix still in play, a window runs over those counters
    only, and a value that fills the column is one counter.  The source is read twice, whatever its size: for the first
    digits, and for the values that share those of a wanted rank, which go on as distinct values with counts.
    """
    keys = group or ["_g"]
    rows = df.where(F.col(value).isNotNull()).select(*(group or [F.lit(0).alias("_g")]), F.col(value).cast("double").alias("_v"))
    # a group may be null, so groups are compared by one column that never is
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    rows = rows.select(key, *keys, "_v", ordered_bits("_v").alias("_bits"), F.lit(1).cast("bigint").alias("_c"))
    same = [F.first(k).alias(k) for k in keys]
    wanted = None
    for step in range(64 // DIGIT):
        base = ["_key", "_up"] if step else ["_key"]
        if step:
            rows = rows.withColumn("_up", F.expr(f"_bits >> {64 - DIGIT * step}"))
            live = rows.join(small_side(wanted.select("_key", "_up").distinct()), base).drop("_up")
            # what is left goes on as distinct values with their counts
            rows = cut_lineage(live.groupBy("_key", "_bits").agg(*same, F.max("_v").alias("_v"), F.sum("_c").alias("_c")))
            live = rows.withColumn("_up", F.expr(f"_bits >> {64 - DIGIT * step}"))
        else:
            live = rows
        digit = F.expr(f"_bits >> {64 - DIGIT * (step + 1)}")
        counts = live.groupBy(*base, digit.alias("_digit")).agg(F.sum("_c").alias("_n"), F.max("_v").alias("_top"), *same)
        run = W.partitionBy(*base).orderBy("_digit").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("_to", F.sum("_n").over(run))
        if step:
            found = counts.join(wanted.drop(*keys, "_top"), base)
        else:
            counts = counts.withColumn("n", F.sum("_n").over(W.partitionBy("_key")))
            pairs = F.array(*[F.struct(F.lit(name).alias("name"), k.cast("bigint").alias("k")) for name, k in ranks.items()])
            found = counts.withColumn("_r", F.explode(pairs)).select("*", F.col("_r.name").alias("_name"), F.col("_r.k").alias("_k"))
        found = found.where((F.col("_k") <= F.col("_to")) & (F.col("_k") > F.col("_to") - F.col("_n")))
        wanted = cut_lineage(found.select("_key", *keys, "_name", (F.col("_k") - F.col("_to") + F.col("_n")).alias("_k"), F.col("_digit").alias("_up"), "_top"))
    picks = [F.max(F.when(F.col("_name") == n, F.col("_top"))).alias(n) for n in ranks]
    return wanted.groupBy("_key").agg(*same, *picks).select(*group, *ranks)


def nearest_rank(q: float) -> Column:
    """1-based rank of quantile ``q``: half-even rounding of q * (n - 1)."""
    return F.rint(F.lit(float(q)) * (F.col("n") - 1)) + 1


def median(df: DataFrame, value: str, group: list[str], name="median") -> DataFrame:
    """Exact median per group, from the two middle order statistics."""
    middle = {"_low": F.floor((F.col("n") + 1) / 2), "_high": F.floor((F.col("n") + 2) / 2)}
    both = order_statistics(df, value, middle, group)
    return both.select(*group, ((F.col("_low") + F.col("_high")) / 2.0).alias(name))


def subject_index(log: DataFrame, measure: str, subject="subject", arm="arm", epoch="epoch") -> DataFrame:
    """One summary row per subject, worst final grade first."""
    first = F.min_by(measure, epoch)
    out = log.groupBy(subject).agg(
        F.max_by(arm, epoch).alias("arm"),
        F.coalesce(F.max(f"{measure}_base"), first).alias(f"baseline_{measure}"),
        F.max_by(f"{measure}_change", epoch).alias("final_change"),
        F.max_by("worst_grade", epoch).alias("worst_grade"),
        F.coalesce(F.sum("n_ae"), F.lit(0)).cast("bigint").alias("n_events"),
        F.coalesce(F.max_by("responder", epoch), F.lit(False)).alias("responder"),
        F.bool_or("discontinued").alias("discontinued"),
        F.bool_or("narrated").alias("narrated"),
    )
    return out.orderBy(F.desc("worst_grade"), F.col(subject).cast("string"))


def subject_details(log: DataFrame, measures: list[str], top=150, subject="subject", epoch="epoch") -> DataFrame:
    """Epoch series of the ``top`` ranked subjects, as an array per subject.

    The top list is bounded by its limit, so it is broadcast; only rows of the
    listed subjects are collected, one struct per epoch.
    """
    best = (
        log.groupBy(subject)
        .agg(F.max_by("worst_grade", epoch).alias("_g"))
        .orderBy(F.desc("_g"), F.col(subject).cast("string"))
        .limit(top)
        .select(subject)
    )
    rows = log.join(F.broadcast(best), subject, "left_semi")
    series = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("epoch"), *measures)))
    return rows.groupBy(subject).agg(series.alias("series"))


def bucket_key(rows: DataFrame, cohort: str, per_bucket: int, name="bucket") -> DataFrame:
    """Sorted distinct cohorts grouped ``per_bucket`` at a time: ``P00000``, ``P00001``, ..."""
    distinct = rows.select(cohort).distinct()
    ranked = range_row_number(distinct, [], [cohort], "_r")
    keys = ranked.select(
        cohort, F.concat(F.lit("P"), F.lpad(F.floor((F.col("_r") - 1) / per_bucket).cast("string"), 5, "0")).alias(name)
    )
    return hot_split_join(rows, keys, cohort, "inner")
