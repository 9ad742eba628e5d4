"""Streaming queries: each drains a file stream and reads back its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.plans import reshapes
from epochwise.plans import views as v
from epochwise.plans.base import ORACLES, query, r
from epochwise.plans.readouts import rounded
from epochwise.plans.statistics import RULES, _rules_cte
from epochwise.plans.views import sql
from epochwise.session import scratch_path
from epochwise.streaming import streams


@query("str01_event_stream", ORACLES["shp01_explode_events"])
def _(spark, d):
    path, out = scratch_path(spark, "log"), scratch_path(spark, "events")
    log = reshapes.log_with_json(spark, d).repartition(4, "subject")
    log.write.parquet(path)
    table = streams.events_to_table(streams.source(spark, path, log.schema, 2), out)
    return table.withColumn("epoch", F.coalesce("epoch", F.lit(-1)))


@query("str02_safety_monitor", sql("trial", _rules_cte() + f" SELECT * REPLACE ({r('observed')} AS observed) FROM evaluated"))
def _(spark, d):
    from epochwise.operators import events

    path, root = scratch_path(spark, "obs"), scratch_path(spark, "monitor")
    packed = events.collect_events(v.ae_events(spark, d), ["subject", "epoch"], reshapes._FIELDS)
    log = v.obs_events(spark, d).select("subject", "arm", "epoch", "y").join(packed, ["subject", "epoch"], "left")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("epoch") * 86400)
    log = log.select("subject", "arm", "epoch", "y", ts.alias("ts"), F.col("events_json").alias("adverse_events_json"))
    # every tenth row arrives twice; four micro-batches in the order of time, each of as many files as there are cores
    arrivals = F.when((F.col("subject") + F.col("epoch")) % 10 == 0, 2).otherwise(1)
    twice = log.select("*", F.explode(F.array_repeat(F.lit(0), arrivals)).alias("again")).drop("again")
    files = spark.sparkContext.defaultParallelism
    twice.repartitionByRange(4 * files, "epoch", "subject").write.parquet(path)
    m = streams.SafetyMonitor(spark, root, "y", floor=60.0, keep_days=366).consume(streams.source(spark, path, log.schema, files))
    return rounded(m.evaluate(RULES), ["observed"])


def _span_files(spark, d):
    path = scratch_path(spark, "spans")
    s = v.spans_events(spark, d).select("trace_id", "kind", "start_time", "duration_ms", "tokens_in", "cache_hit", "status")
    s.repartitionByRange(4, "start_time").write.parquet(path)
    return streams.source(spark, path, s.schema, 1)


_COUNTERS = """count(*) AS spans, count(*) FILTER (kind = 'LLM') AS calls, count(*) FILTER (kind = 'LLM' AND cache_hit) AS cache_hits,
count(*) FILTER (kind = 'LLM' AND status = 'ERROR') AS errors, CAST(coalesce(sum(tokens_in) FILTER (kind = 'LLM'), 0) AS BIGINT) AS tokens_in, max(duration_ms) AS latency_max"""
_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _stamped(df):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.withColumn("window_start", F.date_format("window_start", fmt)).withColumn("window_end", F.date_format("window_end", fmt))


@query(
    "str03_tumbling_windows",
    sql(
        "spans_events",
        f""", b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, start_time) AS w FROM spans_events)
        SELECT strftime(w, {_STAMP}) AS window_start, strftime(w + INTERVAL 6 HOUR, {_STAMP}) AS window_end, {_COUNTERS} FROM b GROUP BY w""",
    ),
)
def _(spark, d):
    return _stamped(streams.telemetry_table(_span_files(spark, d), scratch_path(spark, "telemetry"), "6 hours"))


@query(
    "str03_sliding_windows",
    sql(
        "spans_events",
        f""", b AS (SELECT s.*, time_bucket(INTERVAL 6 HOUR, start_time) - i * INTERVAL 6 HOUR AS w FROM spans_events s, range(0, 4) g(i))
        SELECT strftime(w, {_STAMP}) AS window_start, strftime(w + INTERVAL 24 HOUR, {_STAMP}) AS window_end, {_COUNTERS} FROM b GROUP BY w""",
    ),
)
def _(spark, d):
    return _stamped(streams.telemetry_table(_span_files(spark, d), scratch_path(spark, "telemetry"), "24 hours", "6 hours"))


@query(
    "str03_session_windows",
    sql(
        "spans_events",
        f""", g AS (SELECT *, CASE WHEN start_time - lag(start_time) OVER (PARTITION BY trace_id ORDER BY start_time) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM spans_events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY start_time) AS i FROM g)
        SELECT trace_id, strftime(min(start_time), {_STAMP}) AS window_start, strftime(max(start_time) + INTERVAL 10 MINUTE, {_STAMP}) AS window_end, {_COUNTERS} FROM s GROUP BY trace_id, i""",
    ),
)
def _(spark, d):
    """Two spans far behind the last one move the watermark over all sessions; theirs stays open and is not returned."""
    path = scratch_path(spark, "spans")
    s = v.spans_events(spark, d).select("trace_id", "kind", "start_time", "duration_ms", "tokens_in", "cache_hit", "status")
    s.repartitionByRange("start_time").write.parquet(path)
    end = s.agg(F.max("start_time").alias("t")).select(F.lit("end of input").cast(s.schema["trace_id"].dataType).alias("trace_id"), F.lit("").alias("kind"), (F.col("t") + F.expr("INTERVAL 62 DAYS")).alias("start_time"))
    end = spark.createDataFrame([], s.schema).unionByName(end, allowMissingColumns=True)
    end.write.mode("append").parquet(path)
    end.withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(path)
    table = streams.session_table(streams.source(spark, path, s.schema, 8), scratch_path(spark, "sessions"), "trace_id", "10 minutes")
    return _stamped(table)
