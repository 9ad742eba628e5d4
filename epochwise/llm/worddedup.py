"""Removal of word windows that a smaller document already holds: suffix automata of reference shards, matching statistics.

A shard of the reference is what documents hold under one trigger (see ``repeats``).  A window can only match in the shard of
its trigger, so phrases are sent to that shard and nothing is broadcast: the reference is every smaller document and has no
bound.  A shard has at most ``repeats.HOT`` phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from epochwise.llm.base import query, table
from epochwise.llm.repeats import Repeats, Rolling

LENGTH, TRIGGER = 13, 5


def _words(texts: list[bytes]):
    """Hashes of the words (ASCII white space parts them), words per text, the words joined by one space and their places."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = inside.copy()
    keep[end] = True  # one separator after each word
    flat, place = np.where(inside, raw, 32).astype(np.uint8)[keep], np.cumsum(keep) - 1
    tokens = Rolling(raw.astype(np.uint64) + np.uint64(1)).stretch(start, end)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return tokens, np.diff(np.concatenate([[0], np.searchsorted(start, ends)])), (flat, place[start], place[end])


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest id of a sequence that holds its strings."""

    def __init__(self, sequences: list[list[bytes]], ids: list[int]):
        self.moves, self.link, self.length, self.least = [{}], [-1], [0], [min(ids)]
        for words, who in zip(sequences, ids, strict=True):
            state = 0
            for word in words:
                state = self._extended(state, word)
                self.least[state] = min(self.least[state], who)
        for s in sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])

    def _state(self, moves: dict, length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(1 << 63)
        return len(self.moves) - 1

    def _extended(self, last: int, word: bytes) -> int:
        """The state of the string of ``last`` and the word after it."""
        moves, link, length = self.moves, self.link, self.length
        known = moves[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The strings of ``q`` up to those that end a path over ``p`` get a state of their own."""
        moves, link = self.moves, self.link
        twin = self._state(dict(moves[q]), self.length[p] + 1, link[q])
        link[q] = twin
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = twin
            p = link[p]
        return twin

    def repeated(self, words: list[bytes], who: int, n: int) -> list[tuple[int, int]]:
        """Runs (first, last) of starts of ``n`` words that a sequence of a smaller id holds, by matching statistics: the
        longest match at each word, of which no more than ``n`` words are followed."""
        moves, link, length, least = self.moves, self.link, self.length, self.least
        state = size = 0
        runs: list[tuple[int, int]] = []
        for k, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            if word in moves[state]:
                state = moves[state][word]
                size += 1
            while state and length[link[state]] >= n:
                state = link[state]
                size = length[state]
            if size >= n and least[state] < who:
                at = k - n + 1
                if runs and runs[-1][1] == at - 1:
                    at = runs.pop()[0]
                runs.append((at, k - n + 1))
        return runs


def by_automata(texts: list[bytes], extent: np.ndarray, low: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last): the runs of window starts in each text whose ``n`` words a text of a smaller id holds, too; one
    automaton for each group."""
    found = []
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    ids = low.tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        split = [t.split(b" ") for t in texts[i:j]]
        shard = Automaton(split, ids[i:j])
        for k, words in enumerate(split, i):
            found += [(k, a, b) for a, b in shard.repeated(words, ids[k], n)]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


class _Rest:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def __init__(self, keep: bool):
        self.keep = keep

    def row(self, text: bytes, gone: np.ndarray) -> tuple:
        words = text.split()
        if gone.any():
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        kept = b" ".join(words)
        return len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if self.keep else None

    def table(self, rows: list[tuple]) -> pa.Table:
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)}, schema=self.schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER, keep: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): what is left of each text, its words joined by one space.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller id.  Null texts have no
    words.  A null id counts as the smallest; rows with equal ids do not shorten each other.
    """
    found = Repeats(docs, _words, by_automata, _Rest(keep), length, trigger, id_col, text_col)
    return found.run("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: Every window as text, the smallest document of each, runs of removed places.
SQL = r"""
WITH rows AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM rows),
windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS w FROM starts),
known AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS low FROM windows),
gone AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(p, p + 13)) AS k FROM known WHERE low < doc_id) GROUP BY doc_id),
single AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM rows),
kept AS (
  SELECT s.doc_id, string_agg(word, ' ' ORDER BY k) AS text
  FROM single s ANTI JOIN (SELECT doc_id, unnest(gone) AS k FROM gone) g ON s.doc_id = g.doc_id AND s.k = g.k GROUP BY s.doc_id)
SELECT r.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id LEFT JOIN kept k ON r.doc_id = k.doc_id
"""


@query("op4_worddedup", SQL)
def op4_worddedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")
