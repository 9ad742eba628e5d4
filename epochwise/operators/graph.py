"""Lineage edges, closures and span trees as iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators.ranks import SMALL_SIDE_ROWS, small_side
from epochwise.session import cut_lineage


def edge_table(edges: DataFrame, run_id: str, created_at: str, details: Column | None = None) -> DataFrame:
    """Lineage edges in their table form, details as JSON text."""
    return edges.select(
        "source",
        "target",
        "relation",
        "agent",
        F.lit(run_id).alias("run_id"),
        (F.lit("{}") if details is None else F.to_json(details)).alias("details_json"),
        F.lit(created_at).alias("created_at"),
    )


#: Neighbours that one row of the packed adjacency holds.
WIDE = 4096


def _packed(edges: DataFrame, near: str, far: str) -> DataFrame:
    """(near, nodes): the neighbours of each node in arrays of about WIDE; a hub has several rows."""
    links = edges.select(F.col(near).alias("near"), F.col(far).alias("node")).where("near is not null and node is not null").distinct()
    links = cut_lineage(links)
    hubs = links.groupBy("near").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select(F.col("near").alias("hub"), F.ceil(F.col("n") / WIDE).alias("pieces"))
    cut = links.join(small_side(hubs), F.col("near") == F.col("hub"), "left")
    piece = F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1)))
    return cut.groupBy("near", piece.alias("piece")).agg(F.collect_list("node").alias("nodes")).select("near", "nodes")


def _reach(edges: DataFrame, start: str, near: str, far: str, union_every: int = 16) -> DataFrame:
    links = cut_lineage(_packed(edges, near, far))
    front, seen, rounds = None, None, 0
    while True:
        at = links.where(F.col("near") == start) if front is None else links.join(front, "near", "left_semi")
        step = at.select(F.explode("nodes").alias("node")).distinct()
        found = cut_lineage(step if seen is None else step.join(seen, "node", "left_anti"))
        few = found.limit(SMALL_SIDE_ROWS + 1).count()
        seen, rounds = found if seen is None else seen.unionByName(found), rounds + 1
        if not few:
            return seen
        # a small front goes to the packed rows where they lie; a large one is joined by shuffling
        names = found.select(F.col("node").alias("near"))
        front = F.broadcast(names) if few <= SMALL_SIDE_ROWS else names
        if rounds % union_every == 0:
            seen = cut_lineage(seen)


def upstream(edges: DataFrame, node: str) -> DataFrame:
    """All ancestors of ``node``; cycles end when a round finds nothing new.

    The edges are read once and packed by node.  Each round looks up the nodes found last, drops known nodes and
    checkpoints the rest, so plans stay short and lost executors cost one round.  Edges with a null end are left out.
    """
    return _reach(edges, node, "target", "source")


def downstream(edges: DataFrame, node: str) -> DataFrame:
    """All descendants of ``node``, as :func:`upstream` with the edges reversed."""
    return _reach(edges, node, "source", "target")


def lineage_summary(edges: DataFrame) -> DataFrame:
    """Edge and node counts with the sorted producers."""
    nodes = edges.select("source").unionByName(edges.select(F.col("target").alias("source"))).distinct()
    totals = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("agent") != "", F.col("agent"))))).alias("agents")
    )
    return totals.withColumn("nodes", nodes.agg(F.count("source")).scalar())


def node_kinds(edges: DataFrame, kind: Column) -> DataFrame:
    """Distinct nodes per kind; ``kind`` is computed from column ``node``."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.groupBy(kind.alias("kind")).agg(F.count("node").alias("n"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Root, depth and path of every span; a span without a known parent is a root.

    Ancestor pointers double their reach each round, so a tree of depth d takes
    about log2(d) joins; only spans whose root is not reached yet go into the next
    round, the others stay where they were written.  Paths are arrays until the end,
    so an id may hold any character.  Spans caught in a parent cycle have no root: they
    drop out once their distance covers the whole trace.
    """
    s = spans.select("trace_id", "span_id", F.nullif("parent_id", F.lit("")).alias("parent_id"))
    known = s.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = s.join(known, ["trace_id", "parent_id"], "left")
    state = linked.select(
        "trace_id",
        "span_id",
        F.when(F.col("_known"), F.col("parent_id")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).alias("depth"),
        F.when(F.col("_known"), F.array("parent_id", "span_id")).otherwise(F.array("span_id")).alias("path"),
    )
    last = cut_lineage(state)
    closed = last.where("up is null")
    sizes = s.groupBy("trace_id").agg(F.count("span_id").alias("n"))
    i = 0
    while True:
        open_rows = last.where("up is not null")
        if i >= 3:
            open_rows = open_rows.join(sizes, "trace_id").where(F.col("depth") < F.col("n")).drop("n")
        if open_rows.isEmpty():
            break
        every = closed.unionByName(last.where("up is not null"))
        ends = every.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("path").alias("p2"))
        own = F.expr("slice(path, -depth, depth)")
        moved = open_rows.join(ends, ["trace_id", "up"]).select(
            "trace_id",
            "span_id",
            F.col("up2").alias("up"),
            (F.col("depth") + F.col("d2")).alias("depth"),
            F.concat("p2", own).alias("path"),
        )
        last = cut_lineage(moved)
        closed = closed.unionByName(last.where("up is null"))
        i += 1
    return closed.select("trace_id", "span_id", F.element_at("path", 1).alias("root"), "depth", F.array_join("path", "/").alias("path"))
