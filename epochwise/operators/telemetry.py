"""Call telemetry from trace spans and from narrated observation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.functions.numbers import ratio, rnd
from epochwise.operators import ranks

CALL_KIND = "LLM"


def names_list(c: str):
    """Sorted distinct names as one text; names are a small vocabulary."""
    return F.concat_ws(",", F.sort_array(F.collect_set(c)))


def trace_summary(spans: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row of counts, rates, totals and means; zeros when there are no calls."""
    if run_id is not None:
        spans = spans.where(F.col("attributes")["run_id"] == run_id)
    call = F.col("kind") == CALL_KIND

    def n(cond):
        return F.count(F.when(cond, 1))

    calls = n(call)
    timed = F.when(call & (F.col("duration_ms") > 0), F.col("duration_ms"))
    zero = F.lit(0.0)
    return spans.agg(
        F.count(F.lit(1)).alias("spans"),
        calls.alias("calls"),
        F.count_distinct("trace_id").alias("traces"),
        n(call & F.col("cache_hit")).alias("cache_hits"),
        n(call & (F.col("status") == "ERROR")).alias("errors"),
        rnd(F.coalesce(ratio(n(call & F.col("cache_hit")), calls), zero), 4).alias("cache_hit_rate"),
        rnd(F.coalesce(ratio(n(call & (F.col("status") == "ERROR")), calls), zero), 4).alias("error_rate"),
        F.coalesce(F.sum(F.when(call, F.col("tokens_in"))), F.lit(0)).cast("bigint").alias("tokens_in_total"),
        F.coalesce(F.sum(F.when(call, F.col("tokens_out"))), F.lit(0)).cast("bigint").alias("tokens_out_total"),
        rnd(F.coalesce(F.avg(F.when(call, F.col("tokens_in"))), zero), 4).alias("tokens_in_mean"),
        rnd(F.coalesce(F.avg(F.when(call, F.col("tokens_out"))), zero), 4).alias("tokens_out_mean"),
        rnd(F.coalesce(F.avg(timed), zero), 4).alias("latency_ms_mean"),
        rnd(F.coalesce(F.max(timed), zero), 2).alias("latency_ms_max"),
        names_list("provider").alias("providers"),
        names_list("model").alias("models"),
    )


def percentiles(rows: DataFrame, value: str, qs: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles, rounded to three decimals, one column per entry; without groups, 0 for no rows."""
    group = group or []
    found = ranks.order_statistics(rows, value, {name: ranks.nearest_rank(q) for name, q in qs.items()}, group)
    if not group:  # an aggregate of the one row, or of none
        found = found.agg(*[F.coalesce(F.max(name), F.lit(0.0)).alias(name) for name in qs])
    return found.select(*group, *[rnd(F.col(name), 3).alias(name) for name in qs])


def narrated_summary(log: DataFrame) -> DataFrame:
    """Call statistics from the narrated rows of an observation log."""
    told = log.where("narrated")
    n = F.count(F.lit(1))
    return told.agg(
        n.alias("calls"),
        F.coalesce(ratio(F.count(F.when(F.col("cache_hit"), 1)), n), F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce(ratio(F.count(F.when(F.coalesce("error", F.lit("")) != "", 1)), n), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in_total"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out_total"),
        names_list("model").alias("models"),
        names_list("provider").alias("providers"),
    )


def first_values(log: DataFrame, value: str, order: list[str], limit: int = 4000) -> DataFrame:
    """The first ``limit`` values in log order, with their position."""
    top = log.where("narrated").where(F.col(value).isNotNull()).orderBy(*order).limit(limit)
    packed = top.agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("value")))).alias("a"))
    return packed.select(F.posexplode("a").alias("i", "s")).select((F.col("i") + 1).alias("position"), "s.value")


def flatten(spans: DataFrame, run_id: str | None = None) -> DataFrame:
    """Spans with the attribute map as JSON text in key order."""
    if run_id is not None:
        spans = spans.where(F.col("attributes")["run_id"] == run_id)
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes"))))
    return spans.withColumn("attributes_json", text).drop("attributes")
