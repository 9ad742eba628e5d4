"""Document fingerprints by consistent weighted sampling.

For each of SAMPLES independent draws every weighted term of a document gets a value from two gamma variables and a
uniform one that depend on the term alone; the term with the smallest value, with its quantised weight, is the sample.
Two documents share a sample with the probability of their generalised Jaccard similarity (sum of smaller weights over
sum of larger).  A term's variables are rows of fixed random tables chosen by two parts of its hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import GROUP_BYTES, query, total_bytes

SAMPLES = 128
TABLE_BITS = 13
LOWEST = -(1 << 63)


class Sampler:
    """Fixed random tables; the same on every machine for the same seed."""

    def __init__(self, samples: int = SAMPLES, seed: int = 2024):
        rng = np.random.default_rng(seed)
        shape = (1 << TABLE_BITS, samples)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.draw = np.arange(samples)
        self.salt = rng.integers(0, 1 << 63, samples, dtype=np.uint64)

    def signature(self, weights: dict[str, float]) -> np.ndarray:
        """One 16-bit number a draw; all zeros without terms."""
        if not weights:
            return np.zeros(len(self.draw), np.uint16)
        h = np.fromiter((xxhash.xxh64_intdigest(t) for t in weights), np.uint64, len(weights))
        log_w = np.log(np.fromiter(weights.values(), np.float32, len(weights)))[:, None]
        mask = np.uint64((1 << TABLE_BITS) - 1)
        row = (h & mask).astype(np.int64)
        r = self.r[row]
        level = np.floor(log_w / r + self.beta[row])
        value = self.log_c[(h >> np.uint64(32) & mask).astype(np.int64)] - r * (level - self.beta[row]) - r
        best = value.argmin(axis=0)
        mark = (h[best] ^ self.salt) + level[best, self.draw].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mark = (mark ^ mark >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (mark >> np.uint64(48)).astype(np.uint16)


def terms(text: str) -> Counter:
    """Words of a text with their counts as weights."""
    return Counter(text.split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _ranges(rows: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut points of the ids and, for every range that has rows, its largest id; as many numbers as there are ranges."""
    cuts = rows.approxQuantile("key", [i / groups for i in range(1, groups)], 0.2 / groups) if groups > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))
    shared = cuts.tolist()

    def top(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            at = np.searchsorted(np.array(shared, np.int64), key, "left")
            names, where = np.unique(at, return_inverse=True)
            most = np.full(len(names), LOWEST)
            np.maximum.at(most, where, key)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(most, pa.int64())], names=["range", "most"])

    found = rows.select("key").mapInArrow(top, "range long, most long").groupBy("range").agg(F.max("most").alias("most")).toArrow().sort_by("range")
    return cuts, found.column("range").to_numpy(), found.column("most").to_numpy()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per input row.

    The next document is the one with the next smaller id (after the last the first; null is smallest, equal ids by
    text, larger first).  Documents are dealt by id range; the first of a range also goes to the range before it, so each
    text is shuffled once or twice.  Null is empty; two texts without words have equal fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-total_bytes(rows) // group_bytes))
    cuts, ranges, tops = _ranges(rows, groups)
    shared = docs.sparkSession.sparkContext.broadcast((cuts, ranges, tops))

    def deal(batches):
        cuts, ranges, tops = shared.value
        for b in batches:
            key = b.column(1).to_numpy()
            home = np.searchsorted(ranges, np.searchsorted(cuts, key, "left"))
            first = np.flatnonzero(tops[home] == key)  # also the next document of the range above, or of the lowest one
            both = b.take(pa.array(np.concatenate([np.arange(len(key)), first])))
            to = np.concatenate([home, (home[first] + 1) % len(ranges)])
            guest = np.concatenate([np.zeros(len(key), bool), np.ones(len(first), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(guest), *both.columns], names=["range", "guest", "doc_id", "key", "text"])

    def sign(group: pa.Table) -> pa.Table:
        sampler = _sampler()
        order = group.sort_by([("guest", "ascending"), ("key", "descending"), ("text", "descending")])
        guest, ids, texts = (order.column(c).to_pylist() for c in ("guest", "doc_id", "text"))
        n = guest.count(False)
        texts = texts[: n + 1]  # one guest: the first document of the next range
        out = {f.name: [] for f in _SCHEMA}
        ahead = sampler.signature(terms(texts[0]))
        for k in range(n):
            own, text, following = ahead, texts[k], texts[k + 1]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            changed = sampler.signature(terms(edited))
            ahead = sampler.signature(terms(following))
            row = (ids[k], len(text), edited, hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(own, changed), likeness(own, ahead))
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _SCHEMA}, schema=_SCHEMA)

    dealt = rows.mapInArrow(deal, "range long, guest boolean, doc_id long, key long, text string")
    sql = "doc_id long, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.repartition(groups, "range").groupBy("range").applyInArrow(sign, sql)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_LOADED: list[Sampler] = []


def _sampler() -> Sampler:
    if not _LOADED:
        _LOADED.append(Sampler())
    return _LOADED[0]


@query("op10_weighted")
def op10_weighted(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("edited")
