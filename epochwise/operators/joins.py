"""Dimension look-ups, control matching, report merging, response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.functions.text import WHITE
from epochwise.functions.hashing import stable_hash
from epochwise.session import cut_lineage


def lookup_arm(rows: DataFrame, arms: list[dict], arm="arm") -> DataFrame:
    """Attach protocol attributes by arm; an unknown arm counts as the first arm.

    The arm list is protocol text held by the caller, so its table is broadcast.
    """
    first = arms[0]
    dim = rows.sparkSession.createDataFrame(arms)
    out = rows.join(F.broadcast(dim.withColumn("_known", F.lit(True))), arm, "left")
    for name, value in first.items():
        out = out.withColumn(name, F.when(F.col("_known"), F.col(name)).otherwise(F.lit(value)))
    return out.drop("_known")


def beside_control(rows: DataFrame, measures: list[str], by: list[str], control: str, arm="arm", missing=0) -> DataFrame:
    """Control-arm values next to each row of the same key.

    One row per (key, arm) is expected, so each window group has as many rows
    as there are arms.
    """
    w = W.partitionBy(*by)
    extra = [
        F.coalesce(F.max(F.when(F.col(arm) == control, F.col(m))).over(w), F.lit(missing)).alias(f"control_{m}") for m in measures
    ]
    return rows.select("*", *extra)


def attach_grade_counts(rows: DataFrame, events: DataFrame, grade: int, subject="subject") -> DataFrame:
    name = f"grade{grade}_events"
    counts = events.where(F.col("grade") >= grade).groupBy(subject).agg(F.count("grade").alias(name))
    return rows.join(counts, subject, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def merge_reports(modelled: DataFrame, reports: DataFrame, run_id: str, cap: int = 5) -> DataFrame:
    """Merge reported symptoms into modelled events.

    ``reports`` holds (subject, arm, epoch, position, term, grade, verbatim);
    the first ``cap`` positions of a subject-epoch count.  A report matches the
    modelled event of the same subject, epoch and folded term: a higher reported
    grade wins and marks the event ``hybrid``, a verbatim replaces the old one.
    Reports without a match are appended with source ``llm``.
    """
    key = F.lower(F.trim("term", F.lit(WHITE)))
    m = modelled.withColumn("key", key)
    # At most ``cap`` reports per subject-epoch, so this array is bounded by it.
    entry = F.struct("position", "grade", "term", F.coalesce("verbatim", F.lit("")).alias("verbatim"))
    r = (
        reports.where(F.col("position") <= cap)
        .withColumn("key", key)
        .groupBy("subject", "arm", "epoch", "key")
        .agg(F.array_sort(F.collect_list(entry)).alias("said"))
    )
    both = m.join(r, ["subject", "arm", "epoch", "key"], "full_outer")
    new = F.col("ae_id").isNull()
    # Every unmatched report becomes an event of its own; a modelled event stays one row.
    rows = both.withColumn("one", F.explode(F.when(new, F.col("said")).otherwise(F.slice(F.coalesce("said", F.array(F.lit(None).cast("struct<position:int,grade:int,term:string,verbatim:string>"))), 1, 1))))
    top = F.array_max(F.transform("said", lambda x: x["grade"]))
    up = F.coalesce(top > F.col("grade"), F.lit(False))
    words = F.filter(F.transform("said", lambda x: x["verbatim"]), lambda t: t != "")
    last_words = F.try_element_at(words, F.lit(-1))
    return rows.select(
        F.when(new, stable_hash(run_id, F.col("subject"), F.col("epoch"), F.col("key"), length=20)).otherwise(F.col("ae_id")).alias("ae_id"),
        "subject",
        "arm",
        "epoch",
        F.when(new, F.col("one.term")).otherwise(F.col("term")).alias("term"),
        F.when(new, "Reported by patient (LLM)").otherwise(F.col("soc")).alias("soc"),
        F.when(new, F.col("one.grade")).when(up, top).otherwise(F.col("grade")).alias("grade"),
        F.when(new, F.col("one.grade") >= 3).when(up, F.coalesce("serious", F.lit(False)) | (top >= 3)).otherwise(F.col("serious")).alias("serious"),
        F.when(new, "possible").otherwise(F.col("relatedness")).alias("relatedness"),
        F.when(new, 0.0).otherwise(F.col("p")).alias("p"),
        F.when(new, "llm").when(up, "hybrid").otherwise(F.col("source")).alias("source"),
        F.when(new, F.col("one.verbatim")).otherwise(F.coalesce(last_words, F.col("verbatim"))).alias("verbatim"),
    )


def epoch_burden(events: DataFrame) -> DataFrame:
    """Event count and worst grade per subject-epoch."""
    return events.groupBy("subject", "epoch").agg(F.count("ae_id").alias("n_ae"), F.max("grade").alias("worst_grade"))


def with_request_key(requests: DataFrame, *parts, name="key") -> DataFrame:
    return requests.withColumn(name, stable_hash(*parts, length=32))


def first_per_key(entries: DataFrame, order: str, key="key") -> DataFrame:
    """First written entry of each key, by map-side combined aggregation."""
    rest = [c for c in entries.columns if c != key]
    first = F.min_by(F.struct(*rest), F.col(order))
    return entries.groupBy(key).agg(first.alias("_e")).select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def cache_misses(requests: DataFrame, cache: DataFrame, key="key") -> DataFrame:
    """Distinct request keys the cache does not hold."""
    return requests.select(key).distinct().join(cache.select(key), key, "left_anti")


HOT_SHARE = 1000


def hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a table with hot keys to one that is unique by ``key``.

    A key is hot when it holds more than 1/1000 of the left rows, so there are
    fewer than 1000 hot keys, and their right-side rows may be broadcast.  Hot
    left rows then stay where they are; the others take the ordinary join.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"cannot split a {how} join: rows of the right side would repeat")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.agg(F.count(F.lit(1))).scalar()
    hot = cut_lineage(counts.where(F.col("_n") * HOT_SHARE > total).select(key))
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    of_hot = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return of_hot.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def serve_from_cache(requests: DataFrame, cache: DataFrame, key="key") -> DataFrame:
    """Cached response and ``cache_hit`` beside each request; ``cache`` is unique by key."""
    served = hot_split_join(requests, cache.withColumn("cache_hit", F.lit(True)), key)
    return served.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
