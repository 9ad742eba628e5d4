"""Streams: state kept between runs, late rows, lost files."""

import shutil

import pytest
from pyspark.sql import functions as F

from epochwise.operators import safety
from epochwise.streaming import streams

LOG = "subject bigint, arm string, epoch int, y double, ts timestamp, adverse_events_json string"
RULES = [safety.Rule(m, m, 0.3) for m in ("grade3_plus_rate", "sae_rate", "mortality_rate", "alt_elevation_rate")]


def write(spark, path, rows):
    frame = spark.createDataFrame([(s, a, e, y, j) for s, a, e, y, j in rows], "subject bigint, arm string, epoch int, y double, adverse_events_json string")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("epoch") * 86400)).select("subject", "arm", "epoch", "y", "ts", "adverse_events_json")
    frame.coalesce(1).write.mode("append").parquet(path)


def batch(spark, path):
    """The same rules in batch, over the first observation of each subject and epoch."""
    from epochwise.operators import events

    log = spark.read.schema(LOG).parquet(path).dropDuplicates(["subject", "epoch"])
    worst, serious = events.worst_and_serious(F.col("adverse_events_json"))
    e = log.select("arm", "subject", "epoch", worst.alias("grade"), serious.alias("serious")).where("grade IS NOT NULL")
    return sorted(map(str, safety.stopping_rules(log, e, RULES, elevated_measure="y").collect()))


def test_monitor_over_several_runs(spark, tmp_path):
    """Baselines that come late, earlier hits that come late, repeated rows; a second run goes on from the state."""
    path, root = f"file://{tmp_path}/obs", f"file://{tmp_path}/monitor"
    grave = '\n[{"ctcae_grade": 5, "serious": true}]'
    first = [(s, "ab"[s % 2], e, 40.0 + 30 * e if s % 3 else 5.0, grave if s % 5 == 0 and e == 3 else None) for s in range(30) for e in (1, 3)]
    write(spark, path, first)
    write(spark, path, first[:20])
    m = streams.SafetyMonitor(spark, root, keep_days=100).consume(streams.source(spark, path, spark.read.schema(LOG).parquet(path).schema, 1))
    assert sorted(map(str, m.evaluate(RULES).collect())) == batch(spark, path)
    write(spark, path, [(s, "ab"[s % 2], e, 30.0 if e == 0 else 200.0, grave if s % 5 == 0 else "broken") for s in range(30) for e in (0, 2)])
    write(spark, path, [(99, "a", 4, None, "[]"), (98, "a", 4, float("nan"), grave)])
    schema = spark.read.schema(LOG).parquet(path).schema
    streams.SafetyMonitor(spark, root, keep_days=100).consume(streams.source(spark, path, schema, 1))
    got = sorted(map(str, m.evaluate(RULES).collect()))
    assert got == batch(spark, path) and any("alt_elevation_rate" in x and "triggered=True" in x for x in got)
    # nothing new: nothing changes
    streams.SafetyMonitor(spark, root, keep_days=100).consume(streams.source(spark, path, schema, 1))
    assert sorted(map(str, m.evaluate(RULES).collect())) == got
    # lost state raises instead of starting again
    shutil.copytree(tmp_path / "monitor", tmp_path / "copy")
    shutil.rmtree(tmp_path / "copy/deltas/batch=1")
    with pytest.raises(RuntimeError):
        streams.SafetyMonitor(spark, f"file://{tmp_path}/copy").evaluate(RULES)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        streams.SafetyMonitor(spark, f"file://{tmp_path}/none").evaluate(RULES)


def test_late_span_merges_two_sessions(spark, tmp_path):
    """Spans at 0 and 15 minutes are two sessions of a ten-minute gap until one at 8 minutes arrives later."""
    schema = "trace_id string, kind string, start_time timestamp, duration_ms double, tokens_in bigint, cache_hit boolean, status string"
    path, out = f"file://{tmp_path}/spans", f"file://{tmp_path}/sessions"

    def add(*minutes, trace="t"):
        rows = spark.createDataFrame([(trace, "LLM", m, 1.0, 1, False, "OK") for m in minutes], schema.replace("start_time timestamp", "start_time bigint"))
        rows.withColumn("start_time", F.timestamp_seconds(F.col("start_time") * 60)).coalesce(1).write.mode("append").parquet(path)

    def run():
        return streams.session_table(streams.source(spark, path, spark.read.schema(schema).parquet(path).schema, 1), out, "trace_id", "10 minutes", "1 hour")

    add(0, 15)
    assert run().count() == 0  # still open
    add(8)
    assert run().count() == 0
    add(500, trace="far")
    add(501, trace="far")
    got = [(r.trace_id, r.spans, int((r.window_end - r.window_start).total_seconds())) for r in run().collect()]
    assert got == [("t", 3, 25 * 60)]
    add(9)  # behind the watermark
    assert [r.spans for r in run().collect()] == [3]


def test_monitor_keeps_its_state_without_python(spark, tmp_path, monkeypatch):
    """Many subjects: one pass of the state store for each row, no Python call for each subject; a row sent again counts once."""
    path, root, plans = f"file://{tmp_path}/obs", f"file://{tmp_path}/monitor", []

    def drain(writer):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))

    monkeypatch.setattr(streams, "_drain", drain)
    rows = [(s, "ab"[s % 2], e, 30.0 if e == 0 else 100.0 + s, None) for s in range(2000) for e in (0, 1)]
    write(spark, path, rows)
    write(spark, path, rows[::7])
    for keep in (None, 50):
        m = streams.SafetyMonitor(spark, f"{root}-{keep}", keep_days=keep).consume(streams.source(spark, path, spark.read.schema(LOG).parquet(path).schema, 1))
        assert sorted(map(str, m.evaluate(RULES).collect())) == batch(spark, path)
    assert len(plans) == 2 and not any("Pandas" in p or "Python" in p for p in plans)
