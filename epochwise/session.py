"""Session helpers: where jobs may write, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (single-machine tests) is a local temporary folder created, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes an execution's shuffle files when it ends; it is read when a DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch, read when a plan with Python is run; texts of many rows at once fill buffers on both sides.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut_lineage(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses the only copy.

    What was shuffled for it is not needed once it is written, and is removed at once instead of with the driver's garbage.
    ``arrow_rows`` bounds the batches that its Python functions get.
    """
    spark = df.sparkSession
    shared_dir(spark)
    wanted = {CLEANUP: "true"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return df.select("*").checkpoint(eager=True)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
