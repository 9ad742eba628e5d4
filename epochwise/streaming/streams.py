"""Streams of observation rows and spans, built from the batch operators.

Each job runs with ``availableNow``: it takes what has arrived, in bounded
micro-batches, and stops.  Checkpoints, sinks and state tables live below the
path given by the caller, which must be shared by all executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epochwise.operators import events as ev
from epochwise.operators import safety


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


# --- long events -------------------------------------------------------------
def events_to_table(log: DataFrame, out: str, column="adverse_events_json") -> DataFrame:
    """Explode event JSON as rows arrive and append them to a Parquet table."""
    long = ev.explode_events(log, column)
    _drain(long.writeStream.outputMode("append").format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/_checkpoint"))
    return log.sparkSession.read.schema(long.schema).parquet(f"{out}/events")


# --- interim safety monitor -----------------------------------------------------
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_METRICS = ("grade3_plus_rate", "sae_rate", "mortality_rate")


class SafetyMonitor:
    """First qualifying epoch per subject, kept current as observations arrive; all four metrics.

    Spark's state store holds which observations (subject, arm, epoch) came before: the first one counts, repeated ones never
    do.  A micro-batch writes, under its number, the counts of those newly at risk and what decides first hits: flagged
    epochs (the first of a subject, arm and metric), baselines and readings above the floor.  A replayed batch
    overwrites its own files, so results are exactly-once; a missing batch raises.  First hits are minima over the batches and the
    elevation rule meets baseline and reading there, so either may come late.

    Observations older than the watermark are ignored.  ``keep_days`` bounds the state: an observation is forgotten when the
    watermark, then at least so many days behind, has passed it by as much; those already counted stay counted.
    """

    def __init__(self, spark: SparkSession, root: str, measure: str = "y", fold: float = 3.0, floor: float = 100.0, keep_days: int | None = None):
        self.spark, self.root, self.measure = spark, root, measure
        self.fold, self.floor, self.keep_days = fold, floor, keep_days

    def _file(self, rows: DataFrame, batch: int) -> None:
        y = F.when(~F.isnan("y"), F.col("y"))
        none, subject = F.lit(None).cast("double"), F.col("subject")

        def entry(kind, metric="", subject=subject, arm=F.col("arm"), value=none):
            return F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), subject.alias("subject"), arm.alias("arm"), "epoch", value.alias("value"))

        entries = [entry("risk", subject=F.lit(None).cast(rows.schema["subject"].dataType))]
        entries += [F.when(F.col(m), entry("first", m)) for m in _METRICS]
        entries += [F.when((F.col("epoch") == 0) & y.isNotNull(), entry("base", arm=F.lit(""), value=y)), F.when(y > self.floor, entry("reading", value=y))]
        # texts are parsed here, once a row and by all tasks, not in the few that read the files
        worst, serious = ev.worst_and_serious(F.col("events"))
        told = rows.select("*", F.explode(F.array(F.struct(worst.alias("worst"), serious.alias("serious")))).alias("told"))
        flags = (F.col("told.worst") >= 3, F.col("told.serious"), F.col("told.worst") >= 5)
        told = told.withColumns(dict(zip(_METRICS, flags, strict=True)))
        each = told.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
        at = F.when(F.col("kind") != "first", F.col("epoch"))
        summed = each.groupBy("kind", "metric", "subject", "arm", at.alias("at")).agg(F.min("epoch").alias("epoch"), F.max("value").alias("value"), F.count("*").alias("n")).drop("at")
        marker = self.spark.range(1).select(F.lit("batch").alias("kind"), F.lit(1).cast("bigint").alias("n"))
        summed.unionByName(marker, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")

    def consume(self, log: DataFrame, ts="ts", watermark="31 days", column="adverse_events_json") -> SafetyMonitor:
        at = F.col(ts).cast("timestamp").alias(ts)
        rows = log.select("subject", "arm", F.col("epoch").cast("int").alias("epoch"), F.col(self.measure).cast("double").alias("y"), F.col(column).alias("events"), at)
        keys = ["subject", "arm", "epoch"]
        if self.keep_days is None:
            fresh = rows.withWatermark(ts, watermark).dropDuplicates(keys)
        else:
            fresh = rows.withWatermark(ts, self._longer(watermark)).dropDuplicatesWithinWatermark(keys)
        # the store for keyed state is chosen when the query starts
        before = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        try:
            _drain(fresh.writeStream.outputMode("append").foreachBatch(self._file).option("checkpointLocation", f"{self.root}/_checkpoint"))
        finally:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        return self

    def _longer(self, watermark: str) -> str:
        """The longer one of a delay and ``keep_days``."""
        kept = f"{self.keep_days} days"
        return kept if self.spark.range(1).select(F.expr(f"INTERVAL {kept} + timestamp'1970-01-01' > INTERVAL {watermark} + timestamp'1970-01-01'")).first()[0] else watermark

    def evaluate(self, rules: list[safety.Rule]) -> DataFrame:
        """Rule evaluations from all batches so far."""
        deltas = self.spark.read.parquet(f"{self.root}/deltas")
        batches = deltas.where("kind = 'batch'").agg(F.count_distinct("batch").alias("n"), F.max("batch").alias("last")).first()
        if batches["n"] != (batches["last"] or 0) + 1:
            raise RuntimeError(f"counts of {(batches['last'] or 0) + 1 - batches['n']} batches are missing below {self.root}/deltas")
        base = deltas.where("kind = 'base'").groupBy("subject").agg(F.min_by("value", "batch").alias("base"))
        raised = deltas.where("kind = 'reading'").join(base, "subject").where(F.col("value") >= self.fold * F.col("base"))
        found = deltas.where("kind = 'first'").select("metric", "arm", "subject", "epoch").unionByName(raised.select(F.lit("alt_elevation_rate").alias("metric"), "arm", "subject", "epoch"))
        first = found.groupBy("metric", "arm", "subject").agg(F.min("epoch").alias("epoch"))
        hits = first.groupBy("metric", "arm", F.greatest("epoch", F.lit(0)).alias("epoch")).agg(F.count("*").alias("new_hits"))
        risk = deltas.where("kind = 'risk'").groupBy("arm", "epoch").agg(F.sum("n").alias("n_at_risk"))
        return safety.evaluate(hits, risk, rules)


# --- telemetry by time window ----------------------------------------------------
def call_counters():
    return [
        F.count(F.lit(1)).alias("spans"),
        F.count(F.when(F.col("kind") == "LLM", 1)).alias("calls"),
        F.count(F.when((F.col("kind") == "LLM") & F.col("cache_hit"), 1)).alias("cache_hits"),
        F.count(F.when((F.col("kind") == "LLM") & (F.col("status") == "ERROR"), 1)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("kind") == "LLM", F.col("tokens_in"))), F.lit(0)).cast("bigint").alias("tokens_in"),
        F.max("duration_ms").alias("latency_max"),
    ]


def window_counters(spans: DataFrame, width: str, slide: str | None = None, ts="start_time") -> DataFrame:
    """Counters per tumbling or sliding window of the span start; batch or stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return spans.groupBy(w.alias("w")).agg(*call_counters()).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[
        "spans", "calls", "cache_hits", "errors", "tokens_in", "latency_max"])


def session_counters(spans: DataFrame, by: str, gap: str, ts="start_time") -> DataFrame:
    """Counters per session: spans of one key less than ``gap`` apart."""
    g = spans.groupBy(by, F.session_window(ts, gap).alias("w")).agg(*call_counters())
    return g.select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "spans", "calls", "cache_hits", "errors", "tokens_in", "latency_max")


def session_table(spans: DataFrame, out: str, by: str, gap: str, watermark="31 days", ts="start_time") -> DataFrame:
    """Sessions of a span stream, appended once the watermark has passed their end plus the gap.

    A late span inside the watermark still widens or merges open sessions; sessions of the last ``watermark`` stay open
    until later spans move it on.
    """
    counted = session_counters(spans.withWatermark(ts, watermark), by, gap, ts)
    _drain(counted.writeStream.outputMode("append").format("parquet").option("path", f"{out}/sessions").option("checkpointLocation", f"{out}/_checkpoint"))
    return spans.sparkSession.read.schema(counted.schema).parquet(f"{out}/sessions")


def telemetry_table(spans: DataFrame, out: str, width: str, slide: str | None = None, watermark="31 days", ts="start_time") -> DataFrame:
    """Window counters of a span stream; each update is filed under its batch.

    Readers take a window's newest update, so late spans inside the watermark
    correct earlier figures.
    """
    counted = window_counters(spans.withWatermark(ts, watermark), width, slide, ts)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/updates/batch={batch}")

    _drain(counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/_checkpoint"))
    updates = spans.sparkSession.read.parquet(f"{out}/updates")
    rest = [c for c in counted.columns if c not in ("window_start", "window_end")]
    newest = F.max_by(F.struct(*rest), "batch").alias("s")
    return updates.groupBy("window_start", "window_end").agg(newest).select("window_start", "window_end", "s.*")
