"""Versioned batches: a Parquet dataset partitioned by version, plus a batch log.

Reads take the data and log frames, so they work on any pair of tables with
``_version`` and ``run_id`` columns, and prune partitions by version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "version int, written_at string, run_id string, mode string, rows bigint"


def read_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def read_data(spark: SparkSession, root: str, schema: str = "") -> DataFrame:
    """All batches; a table that was never written is empty, with the columns of ``schema`` (name type, ...) if given."""
    try:
        return spark.read.parquet(f"{root}/data")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], ", ".join(x for x in (schema, "run_id string, _version int") if x))


def append_batch(rows: DataFrame, root: str, run_id: str, mode: str = "append", partition_by: tuple[str, ...] = (), written_at: str | None = None) -> int:
    """Write one batch under a new version and log it; returns the version.

    ``overwrite`` shadows older batches without deleting them.  The log row is
    written last, so a failed write leaves no visible version.  One writer at a
    time is assumed.
    """
    spark = rows.sparkSession
    last = read_log(spark, root).agg(F.max("version").alias("v")).first()["v"] or 0
    version = last + 1
    stamped = rows.withColumn("run_id", F.lit(run_id)).withColumn("_version", F.lit(version))
    stamped.write.mode("append").partitionBy("_version", *partition_by).parquet(f"{root}/data")
    written = spark.read.parquet(f"{root}/data").where(F.col("_version") == version).count()
    when = F.lit(written_at) if written_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    entry = spark.range(1).select(
        F.lit(version).alias("version"),
        when.alias("written_at"),
        F.lit(run_id).alias("run_id"),
        F.lit(mode).alias("mode"),
        F.lit(written).cast("bigint").alias("rows"),
    )
    entry.write.mode("append").parquet(f"{root}/log")
    return version


def batch(data: DataFrame, version: int) -> DataFrame:
    """Rows of one write."""
    return data.where(F.col("_version") == version)


def _last_overwrite(log: DataFrame, upto: int | None = None):
    """Version of the last overwrite (0 if none), as a scalar subquery."""
    if upto is not None:
        log = log.where(F.col("version") <= upto)
    return log.agg(F.coalesce(F.max(F.when(F.col("mode") == "overwrite", F.col("version"))), F.lit(0))).scalar()


def as_of(data: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """State after write ``version``: batches since the last overwrite up to it."""
    return data.where((F.col("_version") <= version) & (F.col("_version") >= _last_overwrite(log, version)))


def latest(data: DataFrame, log: DataFrame) -> DataFrame:
    """Batches from the last overwrite on; all of them if there is none."""
    return data.where(F.col("_version") >= _last_overwrite(log))


def _within(data: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the versions in ``log``: their list is a scalar subquery, which prunes partitions before files are listed for
    reading.  A run's versions are as many as its writes."""
    return data.where(F.array_contains(log.agg(F.collect_set("version")).scalar(), F.col("_version")))


def of_run(data: DataFrame, run_id: str, log: DataFrame | None = None) -> DataFrame:
    """Rows of one run; with the log only the partitions that it wrote are read."""
    own = data.where(F.col("run_id") == run_id)
    return own if log is None else _within(own, log.where(F.col("run_id") == run_id))


def require_run(log: DataFrame, run_id: str) -> None:
    """Raise if no batch was written by the run; reads log rows only."""
    if log.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"no batch was written by run {run_id}")


def require_version(log: DataFrame, version: int) -> None:
    if log.where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} was never written")


def history(log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest writes first."""
    op = F.when(F.col("mode") == "overwrite", "WRITE").otherwise("APPEND")
    return log.select("version", "written_at", op.alias("operation"), "rows", "run_id").orderBy(F.desc("version")).limit(limit)


def beyond_retention(log: DataFrame, keep: int) -> DataFrame:
    """Versions older than the newest ``keep``; the caller drops their partitions.

    The newest ``keep`` versions are a bounded top-k; the rest is an anti join.
    """
    kept = log.select("version").orderBy(F.desc("version")).limit(keep)
    return log.join(F.broadcast(kept), "version", "left_anti") if keep <= 10_000 else log.join(kept, "version", "left_anti")


def newest_run(data: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the run that wrote data last, from its own partitions."""
    run = log.where("rows > 0").agg(F.max_by("run_id", "written_at")).scalar()
    return _within(data.where(F.col("run_id") == run), log.where(F.col("run_id") == run))
