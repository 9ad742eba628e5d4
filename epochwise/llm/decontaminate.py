"""Benchmark decontamination by latent semantic retrieval and word-order checks.

Benchmark items are cut into passages of at most PASSAGE words, taken in blocks of bounded size.  Document frequencies of a
block's vocabulary come from all documents.  The TF-IDF passages are factored by a randomised SVD whose products with
the passage matrix are Spark jobs; the driver holds only vocabulary x rank numbers of one block.  Windows over every
document that carry enough weight are projected; those close to a passage by cosine are candidates.  A candidate counts
if the longest common subsequence of words covers most of the item, or a good part of it and the item's answer.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.llm.base import arrow_map, query, slim, table
from epochwise.session import cut_lineage

PASSAGE, WINDOW, STRIDE = 48, 64, 16
#: Passages of one block, not more than the rank, so that none lies outside the latent space; bounds what is broadcast (a block's vocabulary is at most PASSAGE times as large).
BLOCK = 512
RANK = 512
MIN_COSINE = 0.3
#: Words that are projected at a time; each distinct word of them is looked up once.
SLAB = 1 << 10
#: Share of an item's squared weight that a window must carry to be a candidate.
MIN_MASS = 0.25
#: Share of an item's words in order: alone, and together with its answer.
LCS_ALONE, LCS_WITH_ANSWER = 0.75, 0.6
#: Items with fewer words must occur word for word.
SHORT_ITEM = 8

_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "doc_id long, item_id long, cosine double, lcs double, answer boolean, start_word long, item_words long"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_BLANK).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; one machine-word step for each element of ``b``."""
    full = (1 << len(a)) - 1
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def contains(part: list, whole: list) -> bool:
    n = len(part)
    return n > 0 and any(whole[i : i + n] == part for i in range(len(whole) - n + 1) if whole[i] == part[0])


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(no, item_id, part, words): items cut into passages; items without words give none."""
    schema = "item_id long, part int, words array<binary>"

    def cut(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(t)
                n = -(-len(w) // PASSAGE)  # parts of nearly equal length, so none is a mere rest
                rows += [(i, k, w[k * len(w) // n : (k + 1) * len(w) // n]) for k in range(n)]
            types = [("item_id", pa.int64()), ("part", pa.int32()), ("words", pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], names=[n for n, _ in types])

    return items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def _frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents; counts are summed in each task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(pieces):
        known = shared.value
        count = np.zeros(len(known) + 1, np.int64)  # the last counts documents
        for _, texts in pieces:
            for t in texts:
                count[[known[w] for w in known.keys() & words_of(t)]] += 1
            count[-1] += len(texts)
        at = np.flatnonzero(count)
        yield {"term": at, "n": count[at]}

    rows = docs.mapInArrow(arrow_map(run, schema), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def _product(matrix: DataFrame, q: np.ndarray) -> np.ndarray:
    """A' (A q) for the distributed sparse rows A = matrix(terms, weights)."""
    shared = matrix.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.asarray(w)
                y = w @ shared.value[t]
                for i, x in zip(t, w, strict=True):
                    total[i] = total.get(i, 0) + x * y
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["term", "v"])

    rows = matrix.mapInArrow(run, "term long, v array<double>")
    added = rows.select("term", F.posexplode("v")).groupBy("term", "pos").agg(F.sum("col").alias("x")).toArrow()
    out = np.zeros_like(q)
    out[added.column("term").to_numpy(), added.column("pos").to_numpy()] = added.column("x").to_numpy()
    return out


def randomised_svd(matrix: DataFrame, terms: int, rows: int, rank: int = RANK, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of the distributed rows by subspace iteration from a random start."""
    width = min(rank + 8, terms, rows)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(_product(matrix, q))
    small = q.T @ _product(matrix, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def _weights(words: list[bytes], terms: dict[bytes, int], idf: np.ndarray) -> tuple[list[int], np.ndarray]:
    at, n = np.unique([terms[w] for w in words], return_counts=True)
    return at.tolist(), n * idf[at]


class _Block:
    """What tasks need of one block: vocabulary, weights, latent passages, item words and answers."""

    def __init__(self, terms, idf, basis, latent, norms, owner, items):
        # the last row stands for words outside the vocabulary
        self.terms, self.idf = terms, np.append(idf, 0).astype(np.float32)
        # a window's product with a passage is the sum of its words' products, so these are taken once
        near = (basis * idf[:, None]) @ (latent / norms[:, None]).T
        self.near = np.vstack([near, np.zeros(near.shape[1])]).astype(np.float32)
        self.owner, self.items = owner, items
        self.kinds = {i: frozenset(w) for i, (w, _) in items.items()}
        self.floor = MIN_MASS * float((norms**2).min())

    def search(self, text: str | None) -> list[tuple]:
        """Best accepted match of each item in one text."""
        words = words_of(text)
        if not words:
            return []
        at = np.fromiter(map(self.terms.get, words, repeat(len(self.idf) - 1)), np.int64, len(words))
        best: dict[int, tuple] = {}
        # blocks of STRIDE words are summed once; a window is a few blocks in a row
        per = WINDOW // STRIDE
        for lo in range(0, len(words), SLAB):
            part = at[lo : lo + SLAB + WINDOW]
            edges = np.arange(0, len(part), STRIDE)
            kinds, which = np.unique(part, return_inverse=True)
            times = np.bincount(np.arange(len(part)) // STRIDE * len(kinds) + which, minlength=len(edges) * len(kinds))
            sums = times.reshape(len(edges), len(kinds)).astype(np.float32) @ self.near[kinds]
            mass = np.add.reduceat(self.idf[part] ** 2, edges)
            n = max(1, min(len(edges) - per + 1, SLAB // STRIDE))
            pad = max(0, n + per - 1 - len(edges))
            if pad:
                sums, mass = np.pad(sums, ((0, pad), (0, 0))), np.pad(mass, (0, pad))
            cosine, norms = sums[:n].copy(), mass[:n].copy()
            for k in range(1, per):
                cosine += sums[k : k + n]
                norms += mass[k : k + n]
            cosine /= np.sqrt(np.maximum(norms, 1e-9))[:, None]
            around: dict = {}  # regions of the window at hand
            before = -1
            for k, p in zip(*(x.tolist() for x in np.nonzero((cosine >= MIN_COSINE) & (norms >= self.floor)[:, None])), strict=True):
                item = int(self.owner[p])
                if k != before:
                    around.clear()
                    before = k
                found = self._check(item, words, lo + k * STRIDE, float(cosine[k, p]), around)
                if found and (item not in best or found[1:3] > best[item][1:3]):
                    best[item] = found
        return list(best.values())

    def _check(self, item: int, words: list[bytes], start: int, cosine: float, around: dict) -> tuple | None:
        own, answer = self.items[item]
        reach = max(0, len(own) - PASSAGE) + STRIDE
        if reach not in around:
            region = words[max(0, start - reach) : start + WINDOW + reach]
            around[reach] = region, set(region)
        region, here = around[reach]
        if len(own) < SHORT_ITEM:
            ok = contains(own, region)
            return (item, cosine, 1.0, True, start, len(own)) if ok else None
        # words of the item that the region lacks cannot be in the subsequence
        if len(self.kinds[item] - here) > len(own) - LCS_WITH_ANSWER * len(own) or sum(w in here for w in own) < LCS_WITH_ANSWER * len(own):
            return None
        share = lcs(own, region) / len(own)
        if share < LCS_WITH_ANSWER:
            return None
        told = contains(answer, region)
        if share >= LCS_ALONE or told:
            return (item, cosine, share, told, start, len(own))
        return None


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start_word, item_words): the best match of each document and item.

    Without an answer column an item's last fifth (4 words at least) is its answer.  Null and empty texts match nothing;
    a repeated document row gives its matches again; of repeated item ids the text that sorts last counts.  No
    documents or no items give no rows.
    """
    spark = docs.sparkSession
    rows = slim(docs, id_col, text_col)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), answer.alias("answer")).where("item_id IS NOT NULL")
    items = cut_lineage(_sized(items.groupBy("item_id").agg(F.max(F.struct("text", "answer")).alias("x")).select("item_id", "x.text", "x.answer")))
    half = BLOCK // 2
    small = items.where(F.col("n") <= half)
    found = [_search_block(rows, small.where(within)) for within in _ranges(small, half)]
    # an item of more passages has blocks of its own
    for r in items.where(F.col("n") > half).select("item_id", "n").orderBy("item_id").toLocalIterator():
        block = items.where(F.col("item_id") == r["item_id"])
        parts = [_search_block(rows, block, range(at, min(at + BLOCK, r["n"])), r["n"] > BLOCK) for at in range(0, r["n"], BLOCK)]
        found.append(_merged(reduce(DataFrame.unionByName, parts)) if len(parts) > 1 else parts[0])
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


def _sized(items: DataFrame) -> DataFrame:
    """Items with the number ``n`` of their passages, those without words left out."""

    def count(batches):
        for b in batches:
            n = [-(-len(words_of(t)) // PASSAGE) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["item_id", "text", "answer", "n"])

    return items.mapInArrow(count, "item_id long, text string, answer string, n long").where("n > 0")


def _ranges(items: DataFrame, half: int) -> list[Column]:
    """Conditions on the id that cut items of at most ``half`` passages into blocks of less than twice as many.

    The passages before an item are summed within ranges of ids and over the ranges; items belong together if these sums
    fall into the same multiple of ``half``.
    """
    ordered = cut_lineage(items.select("item_id", "n").orderBy("item_id").withColumn("range", F.spark_partition_id()))
    sums = sorted(map(tuple, ordered.groupBy("range").agg(F.sum("n")).collect()))
    if not sums:
        return []
    offset = F.create_map(*[F.lit(x) for (k, _), at in zip(sums, np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False) for x in (k, at)])
    before = F.element_at(offset, F.col("range")) + F.sum("n").over(Window.partitionBy("range").orderBy("item_id")) - F.col("n")
    first = ordered.select("item_id", F.floor(before / half).alias("block")).groupBy("block").agg(F.min("item_id").alias("lo"))
    cuts = sorted(r["lo"] for r in first.collect())
    return [(F.col("item_id") >= lo) & (F.col("item_id") < hi if hi is not None else F.lit(True)) for lo, hi in zip(cuts, [*cuts[1:], None], strict=True)]


def _merged(found: DataFrame) -> DataFrame:
    """The best match over the blocks of one item; copies of a document row, which match alike in a block, stay as many."""
    value = F.struct("lcs", "cosine", "answer", "start_word", "item_words")
    each = found.groupBy("doc_id", "item_id", "mark", "block").agg(F.max(value).alias("x"), F.count("*").alias("n"))
    best = each.groupBy("doc_id", "item_id", "mark").agg(F.max("x").alias("x"), F.max("n").alias("n"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    return best.select("doc_id", "item_id", "x.*", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(*names)


def _search_block(rows: DataFrame, block: DataFrame, parts: range | None = None, split: bool = False) -> DataFrame:
    """Matches of a block's items.  Of an item that is split only the passages of ``parts`` are projected, and each match
    carries the first of them and a mark of the text; a candidate is checked against the whole item all the same."""
    cut = passages(block) if parts is None else passages(block).where(F.col("part").between(parts.start, parts.stop - 1))
    cut = sorted(cut.collect(), key=lambda r: (r["item_id"], r["part"]))
    assert 0 < len(cut) <= RANK, f"{len(cut)} passages in a block of rank {RANK}"
    spark = rows.sparkSession
    items = {r["item_id"]: (words_of(r["text"]), words_of(r["answer"])) for r in block.select("item_id", "text", "answer").collect()}
    items = {i: (w, told or w[-max(4, len(w) // 5) :]) for i, (w, told) in items.items()}
    terms = {w: k for k, w in enumerate(sorted({bytes(x) for r in cut for x in r["words"]}))}
    count, n = _frequencies(rows, terms)
    idf = np.log((n + 1) / (count + 1)) + 0.1
    weighed = [_weights([bytes(w) for w in r["words"]], terms, idf) for r in cut]
    kinds = {"terms": pa.list_(pa.int64()), "weights": pa.list_(pa.float64())}
    # an Arrow table takes no Python workers of its own
    matrix = spark.createDataFrame(pa.table([pa.array([r[k] for r in weighed], t) for k, t in enumerate(kinds.values())], names=list(kinds)))
    basis = randomised_svd(matrix, len(terms), len(cut))
    latent = np.stack([w @ basis[t] for t, w in weighed])
    # a word's weight is squared at each of its occurrences, in passages as in windows
    norms = np.array([math.sqrt(float(w @ idf[t])) for t, w in weighed])
    shared = spark.sparkContext.broadcast(_Block(terms, idf, basis, latent, norms, [r["item_id"] for r in cut], items))
    names = ["item_id", "cosine", "lcs", "answer", "start_word", "item_words"]
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    extra = [("mark", pa.binary()), ("block", pa.int64())] if split else []
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, kinds, strict=True), *extra])

    def more(text):
        return (hashlib.sha256((text or "").encode()).digest(), parts.start) if split else ()

    def run(pieces):
        block = shared.value
        for ids, texts in pieces:
            hits = [(i, *h, *more(t)) for i, t in zip(ids, texts, strict=True) for h in block.search(t)]
            yield {f.name: [h[k] for h in hits] for k, f in enumerate(schema)}

    return rows.mapInArrow(arrow_map(run, schema), RESULT + (", mark binary, block long" if split else ""))


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
