"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: neighbours of a node are hung under its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    # Partial sums make the minimum cheap for a node that holds a third of all links; the join below
    # has one row a node on its other side, so skewed partitions of it can be split.
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
    joined = both.join(low, both["u"] == low["n"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()
    out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest node of the component.

    Links may repeat, point either way or join a node to itself; an empty table gives an empty one.
    The loop ends when a round leaves the star edges unchanged.  Each round is a reliable checkpoint.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = edges.agg(sign.alias("s")).first()["s"]
    while before["n"]:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        after = edges.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
