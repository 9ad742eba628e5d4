"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 have a midpoint at distance 1 from one and 2 from the other, and their
parities differ.  So every fingerprint emits the ball of radius 1 and, if its parity is odd, also the sphere of
radius 2.  Of three differing bits two lie in the same 32-bit half, so pairs of flips inside one half suffice.

A variant keeps one half of its fingerprint.  That half is the shuffle key: variants that leave it unchanged travel
as one row and are written out in the task that receives them, the others travel alone.  At a shared variant the
members of the radius-1 balls (and those of the spheres with them) are at distance 3 or less, so a star under one of
them keeps the component; no pairs of a group are enumerated.  Every link is verified by its bit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import arrow_map, forest, query, slim, table
from epochwise.llm.components import connected
from epochwise.session import cut_lineage

SEED = 42
RADIUS = 3
#: Rows that are matched at a time; a block ends where the key changes.
BLOCK_ROWS = 1 << 18


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number; zero of none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        octets = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


def simhash(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit number; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        spans = zip((end - length)[: 1 - size].tolist(), end[size - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - size + 1)
    return majority(h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; null and empty texts get zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(pieces):
        for ids, texts in pieces:
            yield {"doc_id": ids, "fp": [simhash(t, size) for t in texts]}

    return slim(docs, id_col, text_col).mapInArrow(arrow_map(run, schema), "doc_id long, fp long")


def variant_keys(fps: DataFrame) -> DataFrame:
    """(half, key, fp): the halves that the variants of a distinct fingerprint keep or turn into.

    half 0 keys by the upper 32 bits, 1 by the lower.  A row whose key is the fingerprint's own half stands for all
    variants that leave the half alone; any other row is one variant.  A flip of an upper bit is needed from both sides
    of a distance-3 pair's even member, but for closer pairs only from the one that has a zero there.
    """
    mask = F.lit((1 << 32) - 1)
    parts = fps.select(
        "fp",
        F.expr("shiftrightunsigned(fp, 32)").alias("hi"),
        F.col("fp").bitwiseAND(mask).alias("lo"),
        (F.bit_count("fp") % 2 == 0).alias("even"),
    )
    one = "shiftleft(1L, b)"
    upper = F.expr(f"transform(filter(sequence(0, 31), b -> even OR (hi & {one}) = 0L), b -> struct(0 AS half, hi ^ {one} AS key))")
    lower = F.expr(f"transform(filter(sequence(0, 31), b -> even), b -> struct(1 AS half, lo ^ {one} AS key))")
    own = F.expr("array(struct(0 AS half, hi AS key), struct(1 AS half, lo AS key))")
    return parts.select("fp", F.explode(F.concat(own, upper, lower)).alias("k")).select("k.half", "k.key", "fp")


def _meet(half: int, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block of rows, all variants of a key being in it; the block's links as a forest."""
    low = np.uint64((1 << 32) - 1)
    shift = np.uint64(32)
    one = [np.uint64(1 << b) for b in range(32)] if half == 0 else [np.uint64(1 << b) for b in range(32, 64)]
    own = (fp >> shift if half == 0 else fp & low) == key
    mine = fp[own]
    moved = key[~own] << shift | (fp[~own] & low) if half == 0 else (fp[~own] >> shift << shift) | key[~own]
    z = np.concatenate([moved, mine, *(mine ^ b for b in one)])
    who = np.concatenate([fp[~own], *[mine] * 33])
    order = np.lexsort((who, z))
    z, who = z[order], who[order]
    first = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
    size = np.diff(np.r_[first, len(z)])
    head = np.repeat(who[first], size)
    ball = head != who
    a, b = [head[ball]], [who[ball]]
    odd = mine[np.bitwise_count(mine) % 2 == 1]
    at_z, at_who = z[first], who[first]
    if len(odd) and len(at_z):
        for i in range(32):
            for j in range(i):
                seek = odd ^ (one[i] | one[j])
                at = np.minimum(np.searchsorted(at_z, seek), len(at_z) - 1)
                hit = (at_z[at] == seek) & (at_who[at] != odd)
                if hit.any():
                    a.append(at_who[at[hit]])
                    b.append(odd[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    near = np.bitwise_count(a ^ b) <= RADIUS
    return forest(a[near].view(np.int64), b[near].view(np.int64))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (half, key); blocks of whole keys are matched one after the other."""

    def solve(half, key, fp):
        for h in np.unique(half):
            at = half == h
            a, b = _meet(int(h), key[at].view(np.uint64), fp[at].view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True)]
        if len(held[0]) < BLOCK_ROWS:
            continue
        changes = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(changes):
            cut = changes[-1] + 1
            yield from solve(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from solve(*held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs with the same components as all verified links; a block sends a node with its smallest root."""
    rows = variant_keys(fps).select("half", "key", "fp").repartition("half", "key").sortWithinPartitions("half", "key")
    return rows.mapInArrow(_match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest id reachable by links.

    Null and empty texts share the fingerprint zero and are linked like others.  Repeated rows and copies keep a row
    each.  A null id keeps its row and never is a component's id unless all ids of it are null.
    """
    marks = cut_lineage(fingerprints(docs, id_col, text_col, size))
    each = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = connected(links(each.select("fp")))
    tagged = each.join(joined, each["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tagged.join(lowest, "root").select(F.col("fp").alias("mark"), "component_id")
    return marks.join(named, marks["fp"] == named["mark"], "left").select("doc_id", "fp", "component_id")


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
