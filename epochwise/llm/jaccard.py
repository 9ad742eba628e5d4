"""Near copies by the Jaccard similarity of shingle sets.

Candidates come in two ways.  SimHash fingerprints of the same shingles are linked by ball hashing as in ``simhash``: texts
whose fingerprints are joined by steps of 3 bits or fewer share a key.  Few pairs below equal sets are so close, so candidates
also share one of BANDS keys, each made of ROWS minimum hashes; at similarity 0.8 a pair shares none with probability
(1 - 0.8**4)**20 = 3e-5, at higher ones less.  Every link of either kind is verified on whole sets.  Inside a key's members components are
grown from one member after the other: each is compared with all that are not yet in a component, so no link between two
components is passed over, no pairs are written out, and a large group of near copies is used up by its first members.

A key whose members are too many or too long for one task is cut into blocks by hash.  Each block is grown by itself, then
the heads of its components are, until no round joins any more.  A key that is one component then (a template and its
copies) is done.  In others every member outside the largest component still meets all members of the key, block by block,
so a cut loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm import simhash
from epochwise.llm.base import TEXT_ROWS, arrow_map, arrow_schema, forest, slim
from epochwise.llm.components import connected
from epochwise.operators.ranks import small_side
from epochwise.session import cut_lineage

SEED = 42
SIMILAR = 0.8
BANDS, ROWS = 20, 4
_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Shingles of which minimum hashes are taken at a time.
SLAB = 1 << 14
#: Members and shingles of a key that one task takes at a time.
WIDE, CELLS = 512, 1 << 21


def hashed(text: str | None, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in order, repeats included (of all words, if they are fewer); words as in SimHash."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    return np.unique(hashed(text, size))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed key a band; none for an empty set, whose copies have the same mark."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), SLAB):
        part = own[at : at + SLAB]
        for k in range(BANDS * ROWS):
            h = part * _FACTOR[k] + _ADD[k]
            low[k] = min(low[k], (h ^ h >> np.uint64(32)).min())
    return [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


_MARKED = "doc_id long, digest binary, mark long, size long, fp long, keys array<long>"
_SETS = "mark long, own binary"


def _mark(packed: bytes) -> int:
    return xxhash.xxh64_intdigest(packed, SEED) - (1 << 63)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest); id and digest name a row: rows that share both are the same text under the same id."""
    rows = slim(docs, id_col, text_col)
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def marked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, digest, mark, size, fp, keys): a hash of each row's shingle set, its size, its SimHash and its band keys."""
    schema = arrow_schema(_MARKED)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                runs = [hashed(t, size) for t in part.column(1).to_pylist()]
                fps = pa.array(list(map(simhash.majority, runs)), pa.int64())
                sets = list(map(np.unique, runs))
                marks = pa.array([_mark(s.tobytes()) for s in sets], pa.int64())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), marks, sizes, fps, pa.array(list(map(band_keys, sets)), pa.list_(pa.int64()))], schema=schema)

    return named(docs, id_col, text_col).mapInArrow(run, _MARKED)


def ball_keys(rows: DataFrame) -> DataFrame:
    """(mark, size, key): one key for all texts whose fingerprints are joined by links of ``simhash.RADIUS`` bits or fewer."""
    own = rows.where("size > 0").select("mark", "size", "fp").distinct()
    joined = connected(simhash.links(own.select("fp").distinct()))
    return own.join(joined, own["fp"] == joined["node"], "left").select("mark", "size", F.xxhash64(F.coalesce("root", "fp"), F.lit("ball")).alias("key"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """(mark, own): the sets of the rows that ``wanted`` (id, dig) names, one row a mark."""
    few = small_side(wanted)
    rows = named(docs, id_col, text_col)
    rows = rows.join(few, rows["doc_id"].eqNullSafe(few["id"]) & rows["digest"].eqNullSafe(few["dig"]), "left_semi")

    def run(pieces):
        for _, texts in pieces:
            packed = [shingles(t, size).tobytes() for t in texts]
            yield {"mark": list(map(_mark, packed)), "own": packed}

    return rows.select("doc_id", "text").mapInArrow(arrow_map(run, arrow_schema(_SETS), rows=500), _SETS).dropDuplicates(["mark"])


def grown(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links (i, j) that join exactly the sets that chains of pairs of at least that similarity join."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    words = np.split(flat, np.cumsum(size)[:-1])
    owner = np.repeat(np.arange(len(sets)), size)
    held = np.zeros(flat.max() + 1, bool)
    out, open_ = [], np.ones(len(sets), bool)
    left = among = len(sets)
    while left:
        seed = int(np.argmax(open_))
        open_[seed], left, frontier = False, left - 1, [seed]
        while frontier and left:
            i = frontier.pop()
            # only members that no component holds yet are looked at
            if 2 * left <= among:
                keep = open_[owner]
                owner, flat, among = owner[keep], flat[keep], left
            held[words[i]] = True
            both = np.bincount(owner[held[flat]], minlength=len(sets))
            held[words[i]] = False
            near = np.flatnonzero(open_ & (both >= similar * (size + size[i] - both) - 1e-9))
            open_[near] = False
            left -= len(near)
            frontier += near.tolist()
            out += [(i, int(j)) for j in near]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, mark, own) come sorted by block; the members of one block are held at a time."""

    def solve(marks, packed):
        if len(marks) > 1:
            pairs = grown([np.frombuffer(p, np.uint64) for p in packed])
            if pairs:
                at = np.array(marks, np.int64)
                i, j = np.array(pairs).T
                a, b = forest(at[i], at[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    block, marks, packed = None, [], []
    for batch in batches:
        for k, m, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != block:
                yield from solve(marks, packed)
                block, marks, packed = k, [], []
            marks.append(m)
            packed.append(p)
    yield from solve(marks, packed)


def _blocks(n: Column, size: Column) -> Column:
    """Blocks that hold ``n`` members with ``size`` shingles in all."""
    return F.ceil(F.greatest(n / WIDE, size / CELLS, F.lit(1.0)))


def _block(count: Column, salt: int) -> Column:
    """The block of a mark; the salt deals each round anew."""
    return F.pmod(F.xxhash64("mark", F.lit(salt)), count)


def _rooted(members: DataFrame, joined: DataFrame) -> DataFrame:
    names = joined.select(F.col("node").alias("mark"), "root")
    return members.join(names, "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def _cut_keys(wide: DataFrame, joined: DataFrame, grow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) after the members (key, mark, size) of cut keys have met across blocks."""

    def heads(rooted):
        """One member for each key and component, of keys with several."""
        each = rooted.groupBy("key", "root").agg(F.min_by(F.struct("mark", "size"), "mark").alias("m"))
        several = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("m.size").alias("cells")).where("n > 1")
        return each.join(several, "key").select("key", "m.mark", "m.size", _blocks(F.col("n"), F.col("cells")).alias("count"), "n")

    before, salt = None, 1
    while True:
        rooted = cut_lineage(_rooted(wide, joined))
        first = cut_lineage(heads(rooted))
        left = first.agg(F.count("*").alias("n")).first()["n"]
        if not left:
            return joined
        if before is not None and left == before:
            break
        # further heads are members of the same keys, so a round only joins what pairs of members join
        found = grow(first.select("mark", F.xxhash64("key", _block(F.col("count"), salt), F.lit(salt)).alias("block")))
        joined = connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        before, salt = left, salt + 1
    # the largest component of a key is done; every other member meets all members of the key
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("cells"))
    total = each.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.max(F.struct("n", "root", "cells")).alias("top"))
    total = total.where("top.n < n").select(
        "key", "main", _blocks(F.col("n"), F.col("cells")).alias("all"), _blocks(F.col("n") - F.col("top.n"), F.col("cells") - F.col("top.cells")).alias("few")
    )
    met = rooted.join(total, "key")
    own = met.select("key", "mark", _block(F.col("all"), 0).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("i"))
    other = met.where("root <> main").select("key", "mark", _block(F.col("few"), salt).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"))
    found = grow(own.unionByName(other).distinct().select("mark", F.xxhash64("key", "i", "j").alias("block")))
    return connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, digest, lead): a row per input row; lead (none, doc_id, digest) names the first row of its component."""
    rows = cut_lineage(marked(docs, id_col, text_col, size), TEXT_ROWS)
    each = rows.groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    keyed = rows.select("mark", "size", F.explode("keys").alias("key")).unionByName(ball_keys(rows)).distinct()
    # the keys of near copies mostly have the same members; one key of each member set does
    members = F.struct(F.count("*").alias("n"), F.bit_xor("mark").alias("x"), F.bit_xor(F.xxhash64("mark")).alias("y"), F.sum("size").alias("cells"))
    several = keyed.groupBy("key").agg(members.alias("who")).where("who.n > 1").groupBy("who").agg(F.min("key").alias("key"))
    several = several.select("key", _blocks(F.col("who.n"), F.col("who.cells")).alias("count"))
    pairs = cut_lineage(keyed.join(several, "key"))

    def grow(blocks):
        """Links (a, b) within the blocks of (mark, block)."""
        wanted = each.join(blocks.select("mark").distinct(), "mark", "left_semi").select(F.col("first.doc_id").alias("id"), F.col("first.digest").alias("dig"))
        whole = blocks.join(shingle_sets(docs, id_col, text_col, size, wanted), "mark").select("block", "mark", "own")
        return cut_lineage(whole.repartition("block").sortWithinPartitions("block", "mark").mapInArrow(_verify, "a long, b long").distinct(), TEXT_ROWS)

    joined = connected(grow(pairs.select("mark", F.xxhash64("key", _block(F.col("count"), 0)).alias("block"))))
    joined = _cut_keys(pairs.where("count > 1").select("key", "mark", "size"), joined, grow)
    tagged = each.join(joined, each["mark"] == joined["node"], "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    lowest = tagged.groupBy("root").agg(F.min("first").alias("lead"))
    led = tagged.join(lowest, "root").select(F.col("mark").alias("own_mark"), "lead")
    return rows.join(led, rows["mark"] == led["own_mark"], "left").select("doc_id", "digest", "lead")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, component_id): one row per input row; component_id is the smallest id reachable by pairs of SIMILAR or more.

    Null and empty texts are copies of each other.  A null id keeps its row and never is a component's id unless all ids
    of it are null.
    """
    return _groups(docs, id_col, text_col, size).select("doc_id", F.col("lead.doc_id").alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The input's rows, one of each component: the row with the smallest id (nulls last), of equal ids the smallest digest of
    the text.  Rows that share an id but are not near copies all stay; of rows with the same id and text, the smallest by
    their other columns stays.
    """
    found = cut_lineage(_groups(docs, id_col, text_col, size))
    own = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & F.col("digest").eqNullSafe(F.col("lead.digest"))
    lost = found.where(~own).select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d")).distinct()
    again = found.where(own).groupBy(F.col("doc_id").alias("__i"), F.col("digest").alias("__d")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")

    def of(names):
        return F.col(id_col).cast("long").eqNullSafe(names["__i"]) & F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))).eqNullSafe(names["__d"])

    lost, again = small_side(lost), small_side(again)
    kept = docs.join(lost, of(lost), "left_anti")
    one = kept.join(again, of(again), "left_semi").groupBy(id_col, text_col).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return kept.join(again, of(again), "left_anti").unionByName(one)
