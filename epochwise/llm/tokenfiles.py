"""Token ids in Simple-8b blocks: encode in id order, write, read back.

A 64-bit word holds a 4-bit selector and 60 bits of ids, as many ids as their width allows.  An id of more than 60 bits
is an escape: its word points into the block's list of raw values.  A block also keeps the number of ids before every
OFFSET_WORDS words, so any part of it can be decoded by itself, and all of it without a loop over ids.

Files are Parquet tables written by Spark, one row a block, so that tasks can be repeated and every store works.
"""

from __future__ import annotations

import os
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochwise.llm.base import query, slim, table, total_bytes
from epochwise.session import scratch_path

#: Ids in a word by selector; widths are 60 // count.  Selector 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
OFFSET_WORDS = 1024
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 20
PART_BYTES = 16 << 20
NULL_ID = -(1 << 63)
#: Words whose ids are kept per worker; the table is emptied when it is full.
KEPT = 600_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, raw values) of unsigned ids; the last word may be padded with zeros."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # exact widths: a float logarithm would be wrong for large ids
    width = np.zeros(n, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        width += big * np.uint8(step)
        rest = np.where(big, rest >> np.uint64(step), rest)
    width += (rest > 0).astype(np.uint8)
    widest = np.concatenate([width, np.zeros(max(COUNTS), np.uint8)])  # of the next k ids
    choice = np.full(n, ESCAPE, np.uint8)
    k = 1
    for selector in reversed(range(len(COUNTS))):
        count = COUNTS[selector]
        if count > k:
            shift = count - k
            widest = np.maximum(widest, np.concatenate([widest[shift:], np.zeros(shift, np.uint8)]))
            k = count
        choice[widest[:n] <= 60 // count] = selector  # later selectors hold more
    jump = np.array([*COUNTS, 1, 1])[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    kind = choice[starts].astype(np.uint64)
    words = kind << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for selector, count in enumerate(COUNTS):
        own = np.flatnonzero(kind == selector)
        for j in range(count if len(own) else 0):
            words[own] |= padded[starts[own] + j] << np.uint64(j * (60 // count))
    own = np.flatnonzero(kind == ESCAPE)
    words[own] |= np.arange(len(own), dtype=np.uint64)
    return words, ids[starts[own]]


def unpack(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([*COUNTS, 1, 1])[kind]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for selector, c in enumerate(COUNTS):
        own = np.flatnonzero(kind == selector)
        mask = np.uint64((1 << 60 // c) - 1)
        for j in range(c if len(own) else 0):
            out[start[own] + j] = words[own] >> np.uint64(j * (60 // c)) & mask
    own = np.flatnonzero(kind == ESCAPE)
    out[start[own]] = raw[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def to_block(docs: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    words, raw = pack(ids)
    count = np.array([*COUNTS, 1, 1])[(words >> np.uint64(60)).astype(np.int64)] if len(words) else np.zeros(0, np.int64)
    offsets = (np.cumsum(count) - count)[::OFFSET_WORDS]
    head = MAGIC + struct.pack("<5Q", len(docs), len(ids), len(words), len(raw), len(offsets))
    return head + b"".join(np.asarray(x, t).tobytes() for x, t in ((docs, "<i8"), (sizes, "<u8"), (offsets, "<u8"), (words, "<u8"), (raw, "<u8")))


def _sections(block: bytes) -> tuple[int, list[np.ndarray]]:
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids, n_words, n_raw, n_offsets = struct.unpack_from("<5Q", block, 4)
    out, at = [], 44
    for n, kind in ((n_docs, "<i8"), (n_docs, "<u8"), (n_offsets, "<u8"), (n_words, "<u8"), (n_raw, "<u8")):
        out.append(np.frombuffer(block, kind, n, at))
        at += 8 * n
    return n_ids, out


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids)."""
    n, (docs, sizes, _, words, raw) = _sections(block)
    return docs, sizes.astype(np.int64), unpack(words, raw, n)


def id_range(block: bytes, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi of a block, decoding only the words around them."""
    n, (_, _, offsets, words, raw) = _sections(block)
    hi = min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint64)
    first = int(np.searchsorted(offsets, lo, "right")) - 1
    last = int(np.searchsorted(offsets, hi, "left"))
    part = words[first * OFFSET_WORDS : last * OFFSET_WORDS]
    return unpack(part, raw, hi - int(offsets[first]))[lo - int(offsets[first]) :]


class Words:
    """Ids of texts by the tokenizers library, one white-space separated word at a time.

    The tokenizer drops white space before its merges, so a text's ids are those of its words in a row.  Words are cut at
    ASCII white space only.  Letters and a tail of ASCII marks never merge, so they are encoded apart; plain letters are
    encoded many at a time and told apart by their end-of-word pieces.
    """

    PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzß" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7))
    MARKS = string.punctuation.encode()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, many texts a call; offsets are not asked for."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, into: dict, keys: list, texts: list[str]) -> None:
        for at in range(0, len(keys), 2000):
            into.update(zip(keys[at : at + 2000], self._each(texts[at : at + 2000]), strict=True))

    def _add_plain(self, names: list[str]) -> None:
        for at in range(0, len(names), 2000):
            part = names[at : at + 2000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(part):  # an end-of-word piece per word, or the words one by one
                self._add(self.cores, part, part)
                continue
            raw, cuts = ids.tobytes(), cut.tolist()
            self.cores.update(zip(part, [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def learn(self, words: set[bytes]) -> None:
        if len(self.kept) + len(words) > KEPT:
            self.kept.clear()
            self.cores, self.tails = {"": b""}, {b"": b""}
        order, marks = list(words), self.MARKS
        heads = [w.rstrip(marks) for w in order]
        names = b"\n".join(heads).decode().lower().split("\n")
        tails = [w[len(h) :] for w, h in zip(order, heads, strict=True)]
        fresh, plain = [x for x in dict.fromkeys(names) if x not in self.cores], self.PLAIN.issuperset
        self._add_plain([x for x in fresh if plain(x)])
        new = list(set(tails).difference(self.tails))
        self._add(self.tails, new, [t.decode() for t in new])
        core, tail = self.cores.get, self.tails
        others = []
        for w, name, t in zip(order, names, tails, strict=True):
            ids = core(name)
            if ids is None:
                others.append(w)
            else:
                self.kept[w] = ids + tail[t] if t else ids
        self._add(self.kept, others, [w.decode() for w in others])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [(t or "").encode().split() for t in texts]
        out = []
        for lo in range(0, len(split), 64):
            part = split[lo : lo + 64]
            missing = set().union(*part).difference(self.kept)
            if missing:
                self.learn(missing)
            look = self.kept.__getitem__
            for words in part:
                try:
                    out.append(b"".join(map(look, words)))
                except KeyError:  # the table was emptied
                    self.learn(set(words))
                    out.append(b"".join(map(look, words)))
        return out


_LOADED: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Blocks of ids in ascending id order (null first, equal ids by text) under ``path``.

    Each document's ids are followed by ``end_id``; a null or empty text has that id alone.  Parts are ranges of ids,
    as many as the text needs.  The tokenizer file must be at ``tokenizer`` on every machine.
    """
    rows = slim(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    parts = max(1, -(-total_bytes(docs, text_col) // PART_BYTES))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = words(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        block, first, docs_, sizes, held, n = 0, 0, [], [], [], 0

        def flush():
            nonlocal block, first, docs_, sizes, held, n
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [block], [first], [len(ids)], [to_block(docs_, sizes, ids)]]
            block, first, docs_, sizes, held, n = block + 1, first + len(ids), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "first", "n_ids", "payload"])

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                for i, ids in zip(piece.column(0).to_pylist(), own.encode(piece.column(1).to_pylist()), strict=True):
                    docs_.append(i)
                    held.append(ids + end)
                    sizes.append(len(ids) // 4 + 1)
                    n += sizes[-1]
                    if n >= BLOCK_IDS:
                        yield flush()
        if docs_:
            yield flush()

    ranged.mapInArrow(run, "part int, block int, first long, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ``ids`` are little-endian 32-bit numbers, start counts the ids of
    all documents before."""
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, sizes, ids = from_block(payload)
                starts = first + np.cumsum(sizes) - sizes
                small = ids.astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
                each = [small[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array([None if d == NULL_ID else d for d in docs.tolist()], pa.int64()), pa.array(starts, pa.int64()), pa.array(each, pa.binary())], names=["part", "doc_id", "inside", "ids"])

    rows = files.select("part", "first", "payload").mapInArrow(run, "part int, doc_id long, inside long, ids binary")
    # as many rows as parts, which are as many as the partitions of the write
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "ids")


@query("op9_tokenfiles")
def op9_tokenfiles(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = read(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
