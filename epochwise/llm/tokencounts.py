"""Token counts that follow edits.

A document keeps the counts of its pre-tokens as leaves of a segment tree.  An edit of a stretch of characters re-encodes
the pre-tokens that it touches, with a little context before (a pre-token may have looked a few characters ahead) and
until the new boundaries meet the old ones again; the leaves there are replaced and the sums above them updated.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import arrow_map, query, slim, table

#: Pre-tokens per leaf of the tree, and how far a pre-token's end may depend on the text behind it.
LEAF = 16
LOOK = 4
#: Pre-tokens whose counts are kept per worker; the table is emptied when it is full.
KEPT = 300_000


class Counter:
    """Tokens of a pre-token by a rank file, remembered."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        for p in set(parts).difference(kept):
            kept[p] = len(self.model.encode_ordinary(p))
        return [kept[p] for p in parts]


@dataclass
class Tree:
    """Pre-token lengths and counts of a text in leaves of about LEAF, and pairwise sums above them."""

    text: str
    leaves: list[tuple[list[int], list[int]]]
    sums: list[np.ndarray]

    @property
    def total(self) -> int:
        return int(self.sums[-1][0, 1]) if len(self.sums[-1]) else 0


def _sums(leaves: list[tuple[list[int], list[int]]]) -> list[np.ndarray]:
    level = np.array([(sum(a), sum(b)) for a, b in leaves], np.int64).reshape(-1, 2)
    out = [level]
    while len(level) > 1:
        level = np.concatenate([level, np.zeros((len(level) % 2, 2), np.int64)])
        level = level[0::2] + level[1::2]
        out.append(level)
    return out


def build(counter: Counter, text: str) -> Tree:
    parts = counter.pattern.findall(text)
    counts = counter.counts(parts)
    lengths = list(map(len, parts))
    leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
    return Tree(text, leaves, _sums(leaves))


def _leaf_at(tree: Tree, position: int) -> tuple[int, int]:
    """(leaf, characters before it) of the leaf that holds a character; found from the root down."""
    at, before = 0, 0
    for level in reversed(tree.sums[:-1]):
        at *= 2
        if at + 1 < len(level) and position >= before + level[at, 0]:
            before += int(level[at, 0])
            at += 1
    return at, before


def edit(counter: Counter, tree: Tree, start: int, end: int, new: str) -> tuple[Tree, int]:
    """(tree of the text with characters start to end replaced, pre-tokens that were encoded again)."""
    text = tree.text[:start] + new + tree.text[end:]
    if not tree.leaves:
        fresh = build(counter, text)
        return fresh, sum(len(a) for a, _ in fresh.leaves)
    shift = len(new) - (end - start)
    first, at = _leaf_at(tree, max(0, start - LOOK))
    lengths, counts = tree.leaves[first]
    keep = 0
    while keep < len(lengths) and at + lengths[keep] + LOOK <= start:
        at += lengths[keep]
        keep += 1
    # old boundaries behind the edit, leaf by leaf, until the new ones meet one of them
    last, place = _leaf_at(tree, min(end, max(0, len(tree.text) - 1)))
    old, k = place, 0
    parts, done = [], at
    for m in counter.pattern.finditer(text, at):
        parts.append(m[0])
        done = m.end()
        while last < len(tree.leaves) and old + shift < done:
            old += tree.leaves[last][0][k]
            k += 1
            if k == len(tree.leaves[last][0]):
                last, k = last + 1, 0
        if old >= end and old + shift == done and done >= start + len(new):
            break
    else:
        last, k = len(tree.leaves), 0
    tail = tree.leaves[last] if last < len(tree.leaves) else ([], [])
    sizes = lengths[:keep] + list(map(len, parts)) + (tail[0][k:] if k else [])
    values = counts[:keep] + counter.counts(parts) + (tail[1][k:] if k else [])
    stop = last + 1 if k else last
    middle = [(sizes[i : i + LEAF], values[i : i + LEAF]) for i in range(0, len(sizes), LEAF)]
    leaves = tree.leaves[:first] + middle + tree.leaves[stop:]
    return Tree(text, leaves, _update(tree.sums, leaves, first, len(middle), stop)), len(parts)


def _update(sums: list[np.ndarray], leaves: list, first: int, size: int, stop: int) -> list[np.ndarray]:
    """Sums after leaves first to stop became ``size`` new ones: with as many leaves only the paths above them change."""
    if stop - first != size:
        fresh = np.array([(sum(a), sum(b)) for a, b in leaves[first : first + size]], np.int64).reshape(-1, 2)
        level = np.concatenate([sums[0][:first], fresh, sums[0][stop:]])
        out = [level]
        while len(level) > 1:
            level = np.concatenate([level, np.zeros((len(level) % 2, 2), np.int64)])
            level = level[0::2] + level[1::2]
            out.append(level)
        return out
    out = [x.copy() for x in sums]
    lo, hi = first, first + size
    out[0][lo:hi] = [(sum(a), sum(b)) for a, b in leaves[lo:hi]]
    for below, level in zip(out, out[1:], strict=False):
        lo, hi = lo // 2, -(-hi // 2)
        for i in range(lo, min(hi, len(level))):
            level[i] = below[2 * i : 2 * i + 2].sum(axis=0)
    return out


_LOADED: dict[tuple, Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Counter(path, pattern)
    return _LOADED[path, pattern]


def middle_edit(text: str) -> tuple[int, int, str]:
    """The edit of the registered query: the characters from n/2 to n/2 + n/20 + 1 give way to the first n/20 + 1."""
    n = len(text)
    size = n // 20 + 1
    return n // 2, min(n, n // 2 + size), text[:size]


def counted(docs: DataFrame, ranks: str, pattern: str, edits=middle_edit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded): counts before and after each text's edit.

    ``edits`` gives (start, end, new text) for a text.  Null is empty; every input row has a row.  The rank file must be
    at ``ranks`` on every machine.
    """
    names = ("doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(pieces):
        counter = _counter(ranks, pattern)
        for ids, texts in pieces:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                tree = build(counter, t or "")
                changed, again = edit(counter, tree, *edits(t or ""))
                rows.append((i, sum(len(a) for a, _ in tree.leaves), tree.total, changed.total, again))
            yield {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return slim(docs, id_col, text_col).mapInArrow(arrow_map(run, schema, rows=200), ", ".join(f"{n} long" for n in names))


@query("op6_tokencounts")
def op6_tokencounts(spark, sf_dir):
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
