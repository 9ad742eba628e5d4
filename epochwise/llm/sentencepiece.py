"""SentencePiece encoding and decoding with N-best segmentation.

Over the lattice of a text's pieces the forward pass keeps the best score up to each position.  A backward A* search from
the end uses these scores as exact heuristics, so hypotheses leave the agenda from best to worst.

No piece runs over the start of a white-space run or over a line break, so the lattice falls apart there; also between Latin
letters and ASCII marks, if the vocabulary has no piece with both.  New segments of
some texts are solved together, a numpy step for each offset and length, and kept in a bounded table.  The N best of a text differ from the best in at most N - 1 segments, and only in
those with the smallest distance between best and second; the search over whole texts is confined to them.
"""

from __future__ import annotations

import heapq
import re
import string
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import arrow_map, query, slim, table

SPACE = "▁"
#: Segments kept per worker, some 350 bytes each.  Once half as many are new, the half before them goes.
KEPT = 120_000
#: Characters of texts whose segments are looked up together, and the longest segment that is solved with others.
PIECE, LONG = 1 << 19, 32
#: Segments that are solved together; each takes some 3 KB while it is.
TOGETHER = 1 << 13
N_BEST = 3
#: Characters of a start of a text that decide which pieces start there, if none of the beginnings is longer.
AHEAD = 5
_COARSE = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape(string.punctuation)
_FINE = f"{SPACE}*[{_LETTER}]++(?![^{_MARK}{SPACE}\n])|{SPACE}*[{_MARK}]++(?![^{_LETTER}{SPACE}\n])|{_COARSE}"
NONE = float("-inf")
PREFIX = object()


class Pieces:
    """Vocabulary of a model file and the search over it."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in every]
        self.byte = {int(self.text[i][3:5], 16): i for i in every if model.is_byte(i)}
        # texts of ids; bytes above 127 stand as lone surrogates until a whole text is put together
        self.said = [self.text[i].replace(SPACE, " ") for i in every]
        for b, i in self.byte.items():
            self.said[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.score))
        # pieces with their scores and the beginnings of pieces, so a walk from a start can end early
        self.reach: dict[str, object] = {t[:k]: PREFIX for t in self.score for k in range(1, len(t))} | self.score
        # a character without a piece is spelled in bytes, each a little worse than the worst real piece
        self.spelled = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10.0
        both = re.compile(f"[{_LETTER}][{_MARK}]|[{_MARK}][{_LETTER}]")
        self.segment = re.compile(_COARSE if any(map(both.search, self.score)) else _FINE)
        # the beginnings of pieces as a tree: node and character lead to a node
        node = {"": 0}
        for t in self.reach:
            node[t] = len(node)
        steps = np.array([(node[t[:-1]] << 21 | ord(t[-1]), k) for t, k in node.items() if t], np.int64)
        self.steps, self.next = steps[np.argsort(steps[:, 0])].T.copy()
        self.own = np.array([self.id.get(t, -1) for t in node], np.int32)
        self.worth = np.array([self.score.get(t, 0.0) for t in node])
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.starts: dict[str, tuple[tuple[int, float], ...]] = {}

    def edges(self, s: str, end: int):
        """(start, score) of the pieces that end at a position."""
        score = self.score.get
        found = False
        for start in range(max(0, end - self.longest), end):
            v = score(s[start:end])
            if v is not None:
                found |= start == end - 1
                yield start, v
        if not found:
            yield end - 1, self.spelled * len(s[end - 1].encode())

    def starting(self, s: str, start: int) -> Sequence[tuple[int, float]]:
        """(length, score) of the pieces that start at a position, in order of length."""
        v = self.reach.get(s[start])
        # a character without a piece is spelled
        out = [(1, self.spelled * len(s[start].encode()) if v is None or v is PREFIX else v)]
        end = start + 1
        while v is not None and end < len(s):
            end += 1
            v = self.reach.get(s[start:end])
            if v is not None and v is not PREFIX:
                out.append((end - start, v))
        # a walk that the end of the text stopped says nothing about longer texts, unless the key is shorter and so holds that end
        if end <= start + AHEAD and (v is None or len(s) < start + AHEAD):
            self.starts[s[start : start + AHEAD]] = tuple(out)
        return out

    def forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """Best and second-best score of every prefix, and where the last piece of its best path starts."""
        known, n = self.starts.get, len(s)
        best, second, back = [0.0] + [NONE] * n, [NONE] * (n + 1), [0] * (n + 1)
        for start in range(n):
            p, q = best[start], second[start]
            for size, v in known(s[start : start + AHEAD]) or self.starting(s, start):
                end, x = start + size, p + v
                if x > best[end]:
                    second[end] = max(best[end], q + v)
                    best[end], back[end] = x, start
                elif x > second[end]:
                    second[end] = x
        return best, second, back

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations as (score, ids), best first; ties by the order of the search."""
        if (s, n) in self.ranked:
            return self.ranked[s, n]
        ahead, _, _ = self.forward(s)
        agenda: list[tuple] = [(-ahead[-1], 0, len(s), 0.0, ())]
        count, out = 0, []
        while agenda and len(out) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += self.ids(s[path[0] : path[1]])
                    path = path[2]
                out.append((behind, ids))
                continue
            for start, v in self.edges(s, at):
                count -= 1
                heapq.heappush(agenda, (-(ahead[start] + v + behind), count, start, v + behind, (start, at, path)))
        self.ranked[s, n] = out
        return out

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode()]

    def keep(self, segment: str, answer: tuple) -> tuple:
        """Both halves of the table hold at most KEPT // 2 segments."""
        if len(self.kept) >= KEPT // 2:
            self.turn()
        self.kept[segment] = answer
        return answer

    def turn(self) -> None:
        self.older, self.kept = self.kept, {}
        self.ranked.clear()
        self.starts.clear()

    def solve(self, segment: str) -> tuple[bytes, float, float]:
        """(ids, best score, distance to the second best) of a segment."""
        hit = self.kept.get(segment)
        if hit is None:
            hit = self.older.get(segment)
            if hit is None:
                best, second, back = self.forward(segment)
                parts, at = [], len(segment)
                while at:
                    parts.append(segment[back[at] : at])
                    at = back[at]
                parts.reverse()
                ids = list(map(self.id.get, parts))
                if None in ids:
                    ids = [i for x in parts for i in self.ids(x)]
                hit = struct.pack(f"<{len(ids)}I", *ids), best[-1], best[-1] - second[-1]
            self.keep(segment, hit)
        return hit

    def pieces_in(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, node) of all pieces in characters; a piece from a start ends at its ``stop`` or before."""
        at, node, found, k = np.arange(len(code)), np.zeros(len(code), np.int64), [], 0
        while len(at):
            key = node << 21 | code[at + k]
            to = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            held = self.steps[to] == key
            at, node, k = at[held], self.next[to[held]], k + 1
            whole = self.own[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), k), node[whole]))
            more = at + k < stop[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def solve_all(self, segments: list[str]) -> list[tuple[str, tuple]]:
        """``solve`` for short segments at once: the same sums, by offset in the segment, then by length of the piece.  Segments
        with a character that has no piece are left out."""
        if not segments:
            return []
        size = np.array(list(map(len, segments)), np.int64)
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner, end = np.repeat(np.arange(len(size)), size), np.cumsum(size)
        start, length, node = self.pieces_in(code, end[owner])
        alone = np.zeros(len(code), bool)
        alone[start[length == 1]] = True
        whole = np.ones(len(size), bool)
        whole[owner[~alone]] = False
        # a segment has one place more than characters
        first = end - size + np.arange(len(size))
        last = first + size
        by = (start - (end - size)[owner[start]]) * (self.longest + 1) + length
        order = np.argsort(by.astype(np.uint16) if by.max(initial=0) < 1 << 16 else by, kind="stable")
        cuts = np.flatnonzero(np.diff(by[order], prepend=-1)).tolist()
        from_ = (start + owner[start])[order]
        to, node = from_ + length[order], node[order]
        value = self.worth[node]
        best, second = np.full(len(code) + len(size), NONE), np.full(len(code) + len(size), NONE)
        back, via = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[first] = 0.0
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=False):
            f, t, v = from_[i:j], to[i:j], value[i:j]
            x, was = best[f] + v, best[t]
            better = x > was
            second[t] = np.where(better, np.maximum(was, second[f] + v), np.maximum(second[t], x))
            best[t] = np.where(better, x, was)
            back[t[better]], via[t[better]] = f[better], node[i:j][better]
        names, ids = [], []
        which = np.flatnonzero(whole)
        at = last[which]
        while len(which):
            names.append(which)
            ids.append(self.own[via[at]])
            at = back[at]
            more = at != first[which]
            which, at = which[more], at[more]
        names, ids = (np.concatenate([*x[::-1], np.zeros(0, np.int64)]).astype(np.int64) for x in (names, ids))
        joined = ids[np.argsort(names, kind="stable")].astype("<u4").tobytes()
        cut = np.concatenate([[0], 4 * np.cumsum(np.bincount(names, minlength=len(size)))]).tolist()
        scores, gaps = best[last], np.full(len(size), -NONE)
        np.subtract(scores, second[last], out=gaps, where=whole)
        done = zip(segments, whole.tolist(), cut, cut[1:], scores.tolist(), gaps.tolist(), strict=False)
        return [(s, (joined[a:b], x, gap)) for s, good, a, b, x, gap in done if good]

    def encode_all(self, texts: list[str | None], n: int = N_BEST):
        """``encode`` of each text; new segments of PIECE characters of texts are solved together."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size + len(texts[at] or "") <= PIECE):
                size += len(texts[at] or "")
                at += 1
            cut = [self.cut(t) for t in texts[first:at]]
            every = set().union(*cut)
            if len(every) < KEPT // 2:
                new = every.difference(self.kept)
                if len(self.kept) + len(new) > KEPT // 2:
                    self.turn()
                    new = every
                again = new.intersection(self.older)
                self.kept.update(zip(again, map(self.older.get, again), strict=True))
                new = [s for s in new.difference(again) if len(s) <= LONG]
                for k in range(0, len(new), TOGETHER):
                    self.kept.update(self.solve_all(new[k : k + TOGETHER]))
            while cut:
                yield self.best(cut.pop(0), n)

    def cut(self, text: str | None) -> list[str]:
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[bytes, list[float], list[bytes]]:
        """(best ids as little-endian 32-bit numbers, scores of the n best, ids of the others)."""
        return self.best(self.cut(text), n)

    def best(self, segments: list[str], n: int) -> tuple[bytes, list[float], list[bytes]]:
        if not segments:
            return b"", [0.0], []
        solved = list(map(self.kept.get, segments))
        if None in solved:
            solved = [x or self.solve(s) for x, s in zip(solved, segments, strict=True)]
        best, scores, gaps = zip(*solved, strict=True)
        best, total = list(best), float(np.sum(scores))
        if n == 1:
            return b"".join(best), [total], []
        gaps = np.array(gaps)
        near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
        near = np.sort(near[np.isfinite(gaps[near])])
        ways: list[tuple[float, tuple]] = [(0.0, ())]  # (loss, other segmentations chosen so far)
        found = {k: self.n_best(segments[k], n) for k in near.tolist()}
        for k, own in found.items():
            more = [(loss + own[0][0] - score, (*chosen, (k, j))) for loss, chosen in ways for j, (score, _) in enumerate(own)]
            ways = heapq.nsmallest(n, more, key=lambda w: w[0])
        others = []
        for _, chosen in ways[1:]:
            way = best.copy()
            for k, j in chosen:
                way[k] = struct.pack(f"<{len(found[k][j][1])}I", *found[k][j][1]) if j else way[k]
            others.append(b"".join(way))
        return b"".join(best), [total - loss for loss, _ in ways], others

    def decode(self, ids: bytes) -> str:
        text = "".join(map(self.said.__getitem__, memoryview(ids).cast("I")))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary per worker and model file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, scores, others, decoded): one row per input row.

    ``ids`` is the best segmentation as little-endian 32-bit numbers, ``scores`` those of the n best (fewer if the text has
    fewer), ``others`` the further segmentations, ``decoded`` the text from ``ids``.  Null is empty: no ids, the score
    zero.  A text's own U+2581 reads back as a space.  The model file must be at ``model`` on every machine.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("scores", pa.list_(pa.float64())), ("others", pa.list_(pa.binary())), ("decoded", pa.string())])

    def run(batches):
        own = pieces(model)
        for ids, texts in batches:
            done = list(own.encode_all(texts, n))
            yield {"doc_id": ids, "ids": [d[0] for d in done], "scores": [d[1] for d in done], "others": [d[2] for d in done], "decoded": [own.decode(d[0]) for d in done]}

    schema_sql = "doc_id long, ids binary, scores array<double>, others array<binary>, decoded string"
    return slim(docs, id_col, text_col).mapInArrow(arrow_map(run, schema, rows=500), schema_sql)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    found = encoded(table(spark, sf_dir, "documents"), default_model())
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.transform("others", lambda x: F.crc32(x)).alias("others_crc32"),
        "scores",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
