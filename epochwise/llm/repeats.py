"""Repeated token windows over a corpus: phrases by a rolling hash, a dictionary of phrases by trigger, content compared.

A document is a sequence of tokens (bytes or words).  Every window of ``n`` tokens is given to the trigger in it: of its
grams of ``w`` tokens the one with the smallest rolling hash (its high 32 bits), the leftmost of equal ones.  Neighbouring windows share
triggers, so a document falls into phrases: a trigger with the run of windows that it serves, and the tokens under them.
Equal windows have equal triggers, hence only phrases with equal triggers need comparing, and equal phrases once.

1. Chunks of documents send each distinct trigger once, with its smallest and largest document.
2. Of triggers found in several documents, chunks send each distinct phrase once, as text, with its smallest document.  Under
   a trigger with over ``hot`` phrases they send its windows instead, each to the bucket of its own hash.
3. Per trigger the distinct phrases form a dictionary; ``judge`` (a suffix array, or suffix automata) finds in it the windows
   that a smaller document holds as well.
4. Chunks mark the tokens under repeated windows.

Chunks and buckets are as many as the text needs, a frequent trigger, phrase or window sends one row a chunk, and nothing is
collected.  Hashes of triggers only route: phrases of different chunks are compared by their text.  Inside a chunk equal
phrases are found by 64-bit hashes; a chunk does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import GROUP_BYTES, hash_group, total_bytes
from epochwise.session import cut_lineage

BASE = 0x9E3779B97F4A7C15
NULL_ID = -(1 << 63)
LOW = np.uint64(0xFFFFFFFF)
#: Tokens that are hashed at a time; a longer document is hashed alone.
PIECE = 1 << 18
#: Phrases under one trigger, summed over chunks, above which its windows travel one by one.
HOT = 4096
#: Bytes of dictionary that are judged at a time.
SLAB = 2 << 20
#: Chunks that one task takes in turn where there are more than 16 for each of the session's partitions.
CHUNKS_A_TASK = 16


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` or more of the base and of its inverse; a worker keeps those that a piece needs."""
    if n not in _POWERS:
        if n < PIECE:
            return powers(PIECE)
        found = [np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        if n > PIECE:
            return tuple(found)
        _POWERS[n] = tuple(found)
    return _POWERS[n]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Rolling:
    """Hashes of any stretch of a token array in constant time; all arithmetic is modulo 2**64 with an odd base."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[: len(tokens)], dtype=np.uint64)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Phrases:
    """Arrays over phrases: document number, first and last window start, trigger, phrase hash; and the rolling hash."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray
    rolling: Rolling

    def windows(self, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, start, hash) of all windows of the chosen phrases."""
        size = self.last[chosen] - self.first[chosen] + 1
        at = np.repeat(self.first[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(self.doc[chosen], size), at, self.rolling.stretch(at, at + n)


def phrases(tokens: np.ndarray, lengths: np.ndarray, n: int, w: int) -> Phrases:
    """Phrases of documents laid end to end; no window crosses a document's end."""
    rolling = Rolling(tokens)
    starts = np.arange(max(0, len(tokens) - n + 1))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64), rolling)
    grams = np.arange(len(tokens) - w + 1)
    value = rolling.stretch(grams, grams + w)
    # high half of the hash, then the place: the smallest is the leftmost of the smallest hashes; documents have less than 2**32 tokens
    least = value & ~LOW | grams.astype(np.uint64)
    k, width = 1, n - w + 1
    while k < width:  # over the next k grams
        step = min(k, width - k)
        least = np.minimum(least[: len(least) - step], least[step:])
        k += step
    ends = np.repeat(np.cumsum(lengths), lengths)
    good = starts + n <= ends[: len(starts)]
    starts, place = starts[good], (least[: len(good)][good] & LOW).astype(np.int64)
    if not len(starts):
        return phrases(tokens[:0], lengths[:0], n, w)
    # windows of two documents never start side by side, or have different places
    new = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.r_[head[1:] - 1, len(starts) - 1]]
    owner = np.searchsorted(np.cumsum(lengths), first, "right")
    return Phrases(owner, first, last, value[place[head]], rolling.stretch(first, last + n), rolling)


def _pieces(texts: list[bytes], view: Callable):
    """(first document, tokens, tokens per document, raw) in pieces of about PIECE tokens."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + len(texts[at]) <= PIECE):
            size += len(texts[at])
            at += 1
        yield first, *view(texts[first:at])


def _smallest(keys: list[np.ndarray], ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by keys and id; True at the first of each key."""
    order = np.lexsort((ids, *reversed(keys)))
    sorted_ = [k[order] for k in keys]
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in sorted_:
        change[1:] |= k[1:] != k[:-1]
    return change, ids[order], *sorted_, *(m[order] for m in more)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers byte by byte of significance, so that equal high bytes cost nothing."""
    return zstandard.compress(b"".join(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays), 1)


def _spread(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary()), ("text", pa.binary())])
TOLD = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
SHARED, HOT_KEY, REPEAT = 0, 1, 2


def _by_bucket(key: np.ndarray, buckets: int, chunk: int, arrays: list[np.ndarray], text=None) -> pa.Table:
    """One row for each bucket: the keys in order as differences, the arrays in the same order, and ``text`` of their places."""
    at = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, at))
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[b] : cut[b + 1]]
        rows.append((b, chunk, _squeeze(np.diff(key[own], prepend=np.uint64(0)), *(a[own] for a in arrays)), text(own) if text else None))
    return _table(SENT, rows)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers from each start, ``size`` of them, laid end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Repeats:
    """Windows of ``n`` tokens that also start in a document with a smaller id, and what remains without them."""

    def __init__(self, docs: DataFrame, view: Callable, judge: Callable, finish: Callable, n: int, w: int, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES):
        self.view, self.judge, self.finish, self.n, self.w, self.hot = view, judge, finish, n, w, HOT
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.groups = max(1, -(-total_bytes(rows) // group_bytes))
        self.rows = rows
        # low bits of a trigger are left out while chance agreements stay rare; two that agree have their phrases compared in vain
        self.shift = np.uint64(max(0, 24 - 2 * self.groups.bit_length()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks get the rest

    def chunks(self) -> DataFrame:
        """(chunk, ids, sizes, text): the documents of a batch that belong to a chunk, their texts compressed together."""

        def shrink(batches):
            for b in batches:
                chunk, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                texts = [(t or "").encode() for t in b.column(2).to_pylist()]
                rows = []
                for c in np.unique(chunk):
                    at = np.flatnonzero(chunk == c)
                    own = [texts[i] for i in at]
                    rows.append((int(c), ids[at].tolist(), [len(t) for t in own], zstandard.compress(b"".join(own), 3)))
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "ids", "sizes", "text"])

        key = F.coalesce("doc_id", F.lit(NULL_ID))
        rows = self.rows.select(hash_group(key, self.groups).alias("chunk"), key.alias("doc_id"), "text")
        return rows.mapInArrow(shrink, "chunk int, ids array<long>, sizes array<long>, text binary")

    def _open(self, part: pa.Table):
        """Ids, texts and, piece by piece, (first document, tokens per document, flat text, phrases) of a chunk."""
        ids, texts = [], []
        for own, sizes, text in zip(part.column("ids").to_pylist(), part.column("sizes").to_pylist(), part.column("text").to_pylist(), strict=True):
            joined = zstandard.decompress(text)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            ids += own
            texts += [joined[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        found = []
        for first, tokens, lengths, flat in _pieces(texts, self.view):
            found.append((first, lengths, flat, phrases(tokens, lengths, self.n, self.w)))
        return np.array(ids, np.int64), texts, found

    def _local(self, ids, found):
        """Phrases of the chunk in one array, by key, phrase and id: (piece, place in piece, id, key, phrase, smallest id of the phrase here, first of its phrase)."""
        piece = np.concatenate([np.full(len(p.doc), k) for k, (*_, p) in enumerate(found)]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p.doc)) for *_, p in found]) if found else np.zeros(0, np.int64)
        own = np.concatenate([ids[first + p.doc] for first, *_, p in found]) if found else np.zeros(0, np.int64)
        key = np.concatenate([p.trigger for *_, p in found]) >> self.shift if found else np.zeros(0, np.uint64)
        phrase = np.concatenate([p.phrase for *_, p in found]) if found else np.zeros(0, np.uint64)
        change, own, key, phrase, piece, place = _smallest([key, phrase], own, piece, place)
        low = own[change][np.cumsum(change) - 1] if len(own) else own
        return piece, place, own, key, phrase, low, change

    def _single(self, ids, found, local, hot: np.ndarray):
        """Windows under hot keys: (piece, start, id, hash, smallest id of the window here, first of its hash)."""
        piece, place, own, key, _, low, _ = local
        chosen = np.isin(key, hot) & (own == low)
        none = np.zeros(0, np.int64)
        at, starts, who, hashes = [none], [none], [none], [none.astype(np.uint64)]
        for k, (first, _, _, p) in enumerate(found):
            doc, start, h = p.windows(place[chosen & (piece == k)], self.n)
            at.append(np.full(len(doc), k))
            starts.append(start)
            who.append(ids[first + doc])
            hashes.append(h)
        change, who, h, at, starts = _smallest([np.concatenate(hashes)], np.concatenate(who), np.concatenate(at), np.concatenate(starts))
        low = who[change][np.cumsum(change) - 1] if len(who) else who
        return at, starts, who, h, low, change

    def run(self, schema: str) -> DataFrame:
        n, buckets, hot_above, judge, finish = self.n, self.groups, self.hot, self.judge, self.finish
        spark = self.rows.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.groups // CHUNKS_A_TASK))
        parts = self.chunks().repartition(tasks, "chunk")

        def send_triggers(part: pa.Table) -> pa.Table:
            ids, _, found = self._open(part)
            _, _, own, key, _, _, change = self._local(ids, found)
            if not len(key):
                return _table(SENT, [])
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            low, high = np.minimum.reduceat(own, head), np.maximum.reduceat(own, head)
            count = np.add.reduceat(change.astype(np.uint64), head)
            # the spread is taken modulo 2**64, as ids may have either sign
            spread = high.view(np.uint64) - low.view(np.uint64)
            return _by_bucket(key[head], buckets, part.column("chunk")[0].as_py(), [low.view(np.uint64), spread, count])

        def judge_triggers(sent: pa.Table) -> pa.Table:
            key, low, spread, count, chunk = _gather(sent, 3)
            order = np.argsort(key, kind="stable")
            key, chunk, low, count = key[order], chunk[order], low[order], count[order]
            high = (low + spread[order]).view(np.int64)
            new = np.r_[True, key[1:] != key[:-1]]
            head, group = np.flatnonzero(new), np.cumsum(new) - 1
            shared = np.minimum.reduceat(low.view(np.int64), head) < np.maximum.reduceat(high, head)
            wide = np.add.reduceat(count, head) > hot_above
            return _tell([(SHARED, chunk, (shared & ~wide)[group], [key]), (HOT_KEY, chunk, (shared & wide)[group], [key])])

        def send_dictionary(part: pa.Table, told: pa.Table) -> pa.Table:
            if not part.num_rows or not told.num_rows:
                return _table(SENT, [])
            heard = _heard(told)
            ids, _, found = self._open(part)
            local = self._local(ids, found)
            piece, place, own, key, phrase, _, change = local
            chosen = change & np.isin(key, heard[SHARED][0])
            piece, place = piece[chosen], place[chosen]
            first, last = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
            for k, (*_, p) in enumerate(found):
                first[piece == k], last[piece == k] = p.first[place[piece == k]], p.last[place[piece == k]]
            at, starts, who, h, _, single = self._single(ids, found, local, heard[HOT_KEY][0])
            piece, first = np.r_[piece, at[single]], np.r_[first, starts[single]]
            last = np.r_[last, starts[single]]
            begin, stop, base = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64), 0
            for k, (_, _, (flat, left, right), _) in enumerate(found):
                mine = piece == k
                begin[mine], stop[mine] = base + left[first[mine]], base + right[last[mine] + n - 1]
                base += len(flat)
            flat = np.concatenate([f[0] for _, _, f, _ in found])

            def text(places: np.ndarray) -> bytes:
                return zstandard.compress(flat[ranges(begin[places], stop[places] - begin[places])].tobytes(), 1)

            own, phrase, key = np.r_[own[chosen], who[single]], np.r_[phrase[chosen], h[single]], np.r_[key[chosen], h[single]]
            counts = [(stop - begin).astype(np.uint64), (last - first).astype(np.uint64)]
            return _by_bucket(key, buckets, part.column("chunk")[0].as_py(), [phrase, own.view(np.uint64), *counts], text)

        def judge_dictionary(sent: pa.Table) -> pa.Table:
            key, phrase, low, size, extent, chunk = _gather(sent, 4)
            low, size, extent = low.view(np.int64), size.astype(np.int64), extent.astype(np.int64)
            cuts, seen = np.concatenate([[0], np.cumsum(size)]).tolist(), {}
            joined = b"".join(zstandard.decompress(t) for t in sent.column("text").to_pylist())
            # the dictionary: distinct texts, their smallest document
            code = np.array([seen.setdefault(joined[i:j], len(seen)) for i, j in zip(cuts, cuts[1:], strict=False)], np.int64)
            texts, total = list(seen), len(seen)
            least = np.full(total, np.iinfo(np.int64).max)
            np.minimum.at(least, code, low)
            trigger, length, windows = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
            trigger[code], length[code], windows[code] = key, size, extent
            order = np.argsort(trigger, kind="stable")
            new = np.r_[True, trigger[order][1:] != trigger[order][:-1]]
            head, group = np.flatnonzero(new), np.cumsum(new) - 1
            differ = np.minimum.reduceat(least[order], head) < np.maximum.reduceat(least[order], head)
            order, group = order[differ[group]], group[differ[group]]
            runs = [(np.zeros(0, np.int64),) * 3]
            if len(order):
                # keys are whole within a slab
                before = np.cumsum(length[order]) - length[order]
                slab = before[np.searchsorted(group, group)] // SLAB
                for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(slab)) + 1):
                    own = order[part]
                    at, a, b = judge([texts[c] for c in own.tolist()], windows[own], least[own], group[part], n)
                    runs.append((own[at], a, b))
            of, a, b = (np.concatenate(x) for x in zip(*runs, strict=True))
            by = np.argsort(of, kind="stable")
            of, a, b = of[by], a[by], b[by]
            entry = np.flatnonzero(low == least[code])  # the phrase in its smallest document
            left, right = np.searchsorted(of, code[entry], "left"), np.searchsorted(of, code[entry], "right")
            run, owner = ranges(left, right - left), np.repeat(entry, right - left)
            again = np.flatnonzero(low > least[code])
            every = np.r_[again, owner]
            from_, to = np.r_[np.zeros(len(again), np.int64), a[run]], np.r_[extent[again], b[run]]
            return _tell([(REPEAT, chunk[every], np.ones(len(every), bool), [phrase[every], from_.astype(np.uint64), to.astype(np.uint64)])])

        def finally_(part: pa.Table, told: pa.Table) -> pa.Table:
            if not part.num_rows:
                return finish.table([])
            heard = _heard(told)
            ids, texts, found = self._open(part)
            local = self._local(ids, found)
            piece, place, own, _, phrase, low, _ = local
            names, a, b = heard[REPEAT]
            by = np.argsort(names, kind="stable")
            names, a, b = names[by], a[by].astype(np.int64), b[by].astype(np.int64)
            left = np.searchsorted(names, phrase, "left")
            count = np.where(own == low, np.searchsorted(names, phrase, "right") - left, 0)
            at, starts, who, h, least, _ = self._single(ids, found, local, heard[HOT_KEY][0])
            single = (who > least) | np.isin(h, names)
            rows = []
            for k, (first, lengths, _, p) in enumerate(found):
                here = piece == k
                step = np.zeros(int(lengths.sum()) + 1, np.int64)
                whole = place[here & (own > low)]
                run, owner = ranges(left[here], count[here]), np.repeat(p.first[place[here]], count[here])
                alone = starts[single & (at == k)]
                np.add.at(step, np.concatenate([p.first[whole], owner + a[run], alone]), 1)
                np.add.at(step, np.concatenate([p.last[whole], owner + b[run], alone]) + n, -1)
                gone = np.cumsum(step[:-1]) > 0
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                for d in range(len(lengths)):
                    i = int(ids[first + d])
                    rows.append((None if i == NULL_ID else i, *finish.row(texts[first + d], gone[cuts[d] : cuts[d + 1]])))
            return finish.table(rows)

        sent_sql, told_sql = "bucket int, chunk int, blob binary, text binary", "chunk int, kind int, blob binary"

        def judged(sent: DataFrame, by: Callable) -> DataFrame:
            return cut_lineage(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(by, told_sql))

        def with_answers(told: DataFrame):
            return parts.groupBy("chunk").cogroup(told.repartition(tasks, "chunk").groupBy("chunk"))

        first = judged(parts.groupBy("chunk").applyInArrow(send_triggers, sent_sql), judge_triggers)
        second = judged(with_answers(first).applyInArrow(send_dictionary, sent_sql), judge_dictionary)
        return with_answers(first.where(F.col("kind") == HOT_KEY).unionByName(second)).applyInArrow(finally_, schema)


def _gather(sent: pa.Table, n: int) -> list[np.ndarray]:
    """The keys and the n arrays of all rows, and the chunk of each entry."""
    parts = [_spread(b, n + 1) for b in sent.column("blob").to_pylist()]
    parts = [[np.cumsum(p[0], dtype=np.uint64), *p[1:]] for p in parts]
    chunk = np.repeat(sent.column("chunk").to_numpy(), [len(p[0]) for p in parts])
    return [*(np.concatenate(x) for x in zip(*parts, strict=True)), chunk]


def _tell(answers: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]) -> pa.Table:
    """(kind, chunk, which of the entries, arrays) as one row for each kind and chunk."""
    rows = []
    for kind, chunk, chosen, values in answers:
        order = np.flatnonzero(chosen)
        order = order[np.argsort(chunk[order], kind="stable")]
        names, at = np.unique(chunk[order], return_index=True)
        for c, own in zip(names, np.split(order, at[1:]), strict=False):
            rows.append((int(c), kind, _squeeze(*(v[own] for v in values))))
    return _table(TOLD, rows)


def _heard(told: pa.Table) -> dict[int, list[np.ndarray]]:
    """The arrays of each kind; keys are distinct and in order."""
    out: dict[int, list] = {SHARED: [], HOT_KEY: [], REPEAT: []}
    for kind, blob in zip(told.column("kind").to_pylist(), told.column("blob").to_pylist(), strict=True):
        out[kind].append(_spread(blob, 3 if kind == REPEAT else 1))
    joined = {k: [np.concatenate(x) for x in zip(*v, strict=True)] or [np.zeros(0, np.uint64)] * 3 for k, v in out.items()}
    return {k: v if k == REPEAT else [np.unique(v[0])] for k, v in joined.items()}
