"""False-discovery control over families of p values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def benjamini_hochberg(rows: DataFrame, p: str, family: list[str], ties: list[str], name="q_value") -> DataFrame:
    """Step-up adjusted values per family; null or NaN p stay out of the family.

    A family is a set of test results (arms x endpoints, arms x terms), already
    aggregated from the data, so its window stays small.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(F.coalesce(F.col(p), F.lit(0.0)))
    rows = rows.withColumn("_ok", valid)
    group = W.partitionBy(*family, "_ok")
    size = F.count(F.lit(1)).over(group)
    rank = F.row_number().over(group.orderBy(F.col(p), *ties))
    rows = rows.withColumn("_m", size).withColumn("_rank", rank)
    down = group.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))
    return rows.withColumn(name, F.when(F.col("_ok"), q)).drop("_ok", "_m", "_rank")
