"""Removal of byte strings that a smaller document already holds: prefix-free parsing, suffix arrays of the dictionary.

Documents are parsed into phrases at rolling-hash triggers (see ``repeats``); a string of ``length`` bytes lies whole in one
phrase.  The suffix array of a dictionary puts its suffixes, hence those of the corpus, into the order of their first
``length`` bytes.  The parse would only order suffixes that agree over a whole phrase, which is past ``length``, so it carries
positions and is not sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from epochwise.llm.base import query, table
from epochwise.llm.repeats import Repeats, ranges

LENGTH, TRIGGER = 50, 20


def _bytes(texts: list[bytes]):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return raw.astype(np.uint64) + np.uint64(1), np.array([len(t) for t in texts], np.int64), (raw, np.arange(len(raw)), np.arange(1, len(raw) + 1))


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    found = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.r_[False, found[1:] != found[:-1]])
    return rank


def by_suffix_array(texts: list[bytes], extent: np.ndarray, low: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last): the runs of window starts in each text whose ``n`` bytes a text of a smaller id holds, too.

    The suffix array is built by prefix doubling from 8 bytes up to ``n``; neighbours with ``n`` bytes in common form a class.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts[:-1])])
    width = 1
    rank = flat.astype(np.uint64)
    while width < min(8, n // 2 + 1) and 2 * width <= n:  # bytes side by side are their own rank
        rank = rank << np.uint64(8 * width) | np.r_[rank[width:], np.zeros(width, np.uint64)]
        width *= 2
    rank = _ranked(rank)
    while 2 * width <= n:
        rank = _ranked(rank << np.uint64(32) | np.r_[rank[width:], np.zeros(width, np.uint64)])
        width *= 2
    start, owner = ranges(begin, extent + 1), np.repeat(np.arange(len(texts)), extent + 1)
    key = rank[start] << np.uint64(32) | rank[start + n - width]
    order = np.argsort(key)
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    who = low[owner[order]]
    least = np.repeat(np.minimum.reduceat(who, head), np.diff(np.r_[head, len(order)]))
    again = np.zeros(len(order), bool)
    again[order] = who > least
    same = np.r_[False, owner[1:] == owner[:-1]]
    first = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & same))
    last = np.flatnonzero(again & ~(np.r_[again[1:], False] & np.r_[same[1:], False]))
    return owner[first], (start - begin[owner])[first], (start - begin[owner])[last]


class _Rest:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    schema = pa.schema([*((n, pa.int64()) for n in names[:4]), (names[4], pa.string()), (names[5], pa.binary())])

    def __init__(self, keep: bool):
        self.keep = keep

    def row(self, text: bytes, gone: np.ndarray) -> tuple:
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if self.keep else None

    def table(self, rows: list[tuple]) -> pa.Table:
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)}, schema=self.schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id.  Null texts are empty.
    A null id counts as the smallest; rows with equal ids do not shorten each other.  ``keep=False`` leaves ``kept`` null.
    """
    found = Repeats(docs, _bytes, by_suffix_array, _Rest(keep), length, trigger, id_col, text_col)
    return found.run("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: Every window as text, the smallest document of each, runs of removed places.
SQL = """
WITH rows AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM rows),
windows AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS w FROM starts),
known AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS low FROM windows),
steps AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 50 AS fresh FROM known WHERE low < doc_id),
numbered AS (SELECT doc_id, p, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM steps),
spans AS (SELECT doc_id, span, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
kept AS (
  SELECT r.doc_id, any_value(h) AS h, count(s) AS n_spans, coalesce(sum(e - s), 0) AS n_removed, coalesce(max(e), 0) AS tail,
         coalesce(string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s), '') AS heads
  FROM rows r LEFT JOIN gaps g ON r.doc_id = g.doc_id GROUP BY r.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(heads || substring(h, 2 * tail + 1))) AS kept_sha256
FROM kept
"""


@query("op3_bytededup", SQL)
def op3_bytededup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")
