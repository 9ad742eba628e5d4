"""Column-pruned Parquet reads, tolerant JSON-lines reads, bounded samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epochwise.functions.hashing import stable_seed
from epochwise.operators.contract import declared_subset


def read_columns(spark: SparkSession, path: str, wanted: list[str], schema: StructType | None = None) -> DataFrame:
    """Only the wanted columns that exist; an empty frame if the path is absent.

    The projection reaches the Parquet reader, so other columns are never read.
    """
    try:
        return declared_subset(spark.read.parquet(path), wanted)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema or StructType([]))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Known fields of a JSON-lines log; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bounded_sample(rows: DataFrame, cap: int, seed: str, key: list[str]) -> DataFrame:
    """At most ``cap`` rows, chosen by a seeded draw on the key.

    A top-k over the draw: each task keeps ``cap`` rows, whatever its input.
    """
    draw = stable_seed(seed, *[F.col(k) for k in key])
    return rows.orderBy(draw, *key).limit(cap)
