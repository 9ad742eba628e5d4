"""Dataset export with a variable dictionary and row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows), counted inside one job."""
    out = None
    for name, df in datasets.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def dictionary(spark: SparkSession, labels: dict[str, dict[str, str]]) -> DataFrame:
    """One row per dataset variable with its label."""
    rows = [(name, i + 1, var, label) for name, vars_ in labels.items() for i, (var, label) in enumerate(vars_.items())]
    return spark.createDataFrame(rows, "dataset string, position int, variable string, label string")


def export(datasets: dict[str, DataFrame], labels: dict[str, dict[str, str]], directory: str, fmt: str = "csv") -> DataFrame:
    """Write every dataset in parallel part files, then the dictionary with counts.

    Counts come from the written files, so the dictionary describes what is there.
    """
    spark = next(iter(datasets.values())).sparkSession
    written = {}
    for name, df in datasets.items():
        path = f"{directory}/{name.lower()}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(path)
            written[name] = spark.read.schema(df.schema).option("header", True).csv(path)
        else:
            writer.parquet(path)
            written[name] = spark.read.parquet(path)
    counts = row_counts(written)
    dictionary(spark, labels).join(counts, "dataset").write.mode("overwrite").json(f"{directory}/define")
    return counts
