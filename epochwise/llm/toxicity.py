"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is the bag of its words and of their byte n-grams (3 to 5 bytes, word ends included), hashed into buckets.  The
averaged bucket vectors feed a two-class softmax.  Vectors and weights are trained together on a bounded sample of
labelled rows on the driver; scoring runs over all rows in Arrow batches.  As averaging and the softmax input are linear,
each bucket is reduced to one number before scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import arrow_map, query, slim, table

BUCKET_BITS = 17
SIZES = (3, 4, 5)
#: Rows of each class that the fit uses at most, and the longest text among them in bytes (a bound of the fit only).
SAMPLE_PER_CLASS = 2000
SAMPLE_TEXT_BYTES = 1 << 16
#: A gram gets a vector if it is in so many sample texts and its share differs between the classes by so many deviations.
MIN_TEXTS, MIN_Z = 4, 3.5
#: Texts are hashed in pieces of about this many bytes; a task holds some hundred times as much while it does.
PIECE_BYTES = 1 << 17


@dataclass
class Model:
    """Log-odds of a text: ``bias`` plus the mean of ``weight`` over its grams."""

    weight: np.ndarray
    bias: float


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text of each gram, bucket of each gram), piece by piece."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        first = at
        while at < len(texts) and (not parts or size < PIECE_BYTES):
            parts.append((texts[at] or "").lower().encode())
            size += len(parts[-1]) + 1
            at += 1
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        letter = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
        b = np.where(letter, raw, np.uint8(32)).astype(np.uint32)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + 1 for p in parts])
        blank = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
        docs, buckets = [], []
        h = b.copy()
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
            if n in SIZES:  # a gram may start or end with a blank but hold none inside
                ok = np.flatnonzero(blank[n - 1 : len(raw)] == blank[1 : len(raw) - n + 2])
                docs.append(owner[np.minimum(ok, len(owner) - 1)])
                buckets.append(_bucket(h[ok], n))
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        # a word's hash from prefix sums; the multiplier is odd, so powers can be divided out
        powers = np.cumprod(np.full(len(raw), 0x01000193, np.uint32), dtype=np.uint32)
        sums = np.concatenate([[0], np.cumsum(b * powers, dtype=np.uint32)]).astype(np.uint32)
        back = np.cumprod(np.full(len(raw), pow(0x01000193, -1, 1 << 32), np.uint32), dtype=np.uint32)
        docs.append(owner[np.minimum(starts, len(owner) - 1)])
        buckets.append(_bucket((sums[ends] - sums[starts]) * back[starts], 1))
        yield first, len(parts), np.concatenate(docs), np.concatenate(buckets)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def _bags(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, text, bucket, share of the text's grams) of distinct buckets, piece by piece."""
    for first, n, doc, bucket in grams(texts):
        key, count = np.unique(doc.astype(np.int64) << BUCKET_BITS | bucket, return_counts=True)
        at = key >> BUCKET_BITS
        yield first, n, at, key & ((1 << BUCKET_BITS) - 1), count / np.bincount(doc, minlength=n)[at]


def fit(texts: list[str | None], labels: list[int], prior: float, dim: int = 8, epochs: int = 40, seed: int = 7) -> Model:
    """Vectors and softmax weights by Adam on mini-batches; the bias is moved from the sample's class share to ``prior``."""
    size = 1 << BUCKET_BITS
    if not texts:
        return Model(np.zeros(size, np.float32), -4.0)
    y = np.asarray(labels, np.float32)
    # only grams whose share of texts differs between the classes get a vector; all count in the average
    in_bad, in_any = np.zeros(size), np.zeros(size)
    for first, n, at, bucket, _ in _bags(texts):
        in_bad += np.bincount(bucket, y[first + at], minlength=size)
        in_any += np.bincount(bucket, minlength=size)
    bad, clean = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    pooled = in_any / len(y)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / clean)) + 1e-9
    chosen = (in_any >= MIN_TEXTS) & (np.abs(in_bad / bad - (in_any - in_bad) / clean) / spread >= MIN_Z)
    cols, vals, per = [], [], []
    for _, n, at, bucket, share in _bags(texts):
        kept = chosen[bucket]
        cols.append(bucket[kept].astype(np.int32))
        vals.append(share[kept].astype(np.float32))
        per.append(np.bincount(at[kept], minlength=n))
    cols, vals, ptr = np.concatenate(cols), np.concatenate(vals), np.concatenate([[0], np.cumsum(np.concatenate(per))])
    rng = np.random.default_rng(seed)
    scale = np.float32(100)  # the average is small where a few words matter; a constant factor speeds the fit
    emb = (rng.standard_normal((size, dim)) * 0.01).astype(np.float32)
    out = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for rows in (order[i : i + 128] for i in range(0, len(order), 128)):
            step += 1
            part = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            own = np.repeat(np.arange(len(rows)), ptr[rows + 1] - ptr[rows])
            used, c = np.unique(cols[part], return_inverse=True)
            v = vals[part] * scale
            mean = np.stack([np.bincount(own, emb[cols[part], d] * v, minlength=len(rows)) for d in range(dim)], 1).astype(np.float32)
            logit = mean @ out + bias
            err = np.exp(logit - logit.max(1, keepdims=True))
            err /= err.sum(1, keepdims=True)
            err[np.arange(len(rows)), y[rows].astype(int)] -= 1
            err /= len(rows)
            back = err @ out.T
            g_emb = np.stack([np.bincount(c, back[own, d] * v, minlength=len(used)) for d in range(dim)], 1).astype(np.float32)
            moves = ((emb, used, g_emb + 1e-6 * emb[used]), (out, slice(None), mean.T @ err), (bias, slice(None), err.sum(0)))
            for (p_, at, g), (m, s) in zip(moves, state, strict=True):
                m[at] = 0.9 * m[at] + 0.1 * g
                s[at] = 0.999 * s[at] + 0.001 * g * g
                p_[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.999**step)) + 1e-8)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model((scale * emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def log_odds(model: Model, texts: list[str | None]) -> np.ndarray:
    """One number a text; texts without a word get the bias."""
    result = np.full(len(texts), model.bias)
    for first, n, doc, bucket in grams(texts):
        total = np.bincount(doc, minlength=n)
        score = np.bincount(doc, model.weight[bucket], minlength=n) / np.maximum(total, 1)
        result[first : first + n] += score
    return result


def held_out(id_col: str | Column) -> Column:
    """True for the fifth of all ids that no fit may see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of each class, in the order of a hash of the id.

    Rows without a label, without an id or held out are not used; of repeated labels the largest counts.  Only ids of the
    sample are broadcast (2 x ``per_class`` at most).  An empty sample gives a model that calls nothing toxic.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key"))
        .groupBy("key")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = [known.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(per_class) for v in (0, 1)]
    sample = pick[0].unionByName(pick[1])
    rows = (
        slim(docs, id_col, text_col)
        .where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
        .join(F.broadcast(sample), F.col("doc_id") == F.col("key"))
        .select("doc_id", "label", "text")
        .dropDuplicates(["doc_id"])
        .toArrow()
        .sort_by("doc_id")
    )
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(rows.column("text").to_pylist(), [int(v == 1) for v in rows.column("label").to_pylist()], prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row per input row; a null text is scored as an empty one, whole texts are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(pieces):
        for ids, texts in pieces:
            yield {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(log_odds(shared.value, texts), -500, 500)))}

    return slim(docs, id_col, text_col).mapInArrow(arrow_map(run, schema), "doc_id long, score double")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = scored(docs, train(docs, labels))
    return marks.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
