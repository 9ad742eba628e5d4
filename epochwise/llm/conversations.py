"""Repair of damaged conversations at least cost, the ASCII-least edit string among the cheapest.

A repaired conversation has role initials ``(s?(ua)+)?``.  That is an automaton of four states in which a row's edit, or an
inserted row, leads to one state only; the role that an insertion or a new role must have follows from the state.

Rows are sorted by conversation and turn over all tasks, so one conversation may spread over many, and cut into blocks of
bounded size.  A block's costs are a min-plus matrix (state before, state after).  Matrices alone, a few numbers a block, run
backwards through a conversation and give each block the cost of the best ending from every state.  With it a block is
solved on its own: cost DP, then the arcs that keep to the least cost are ranked by the edit strings of length 1, 2, 4, ...
that begin with them; a rank of the next length is the pair of ranks of an arc and of its doubled pointer.  The least arc
out of each entry state and the doubled pointers give the block's path, for all four states.  A last pass in order picks the
entry state of each block and streams the repaired rows into the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import Batches, arrow_rows, query, table
from epochwise.operators.ranks import SMALL_SIDE_ROWS
from epochwise.session import cut_lineage

#: Costs of edits, of a truncated row that stays; ASCII white space, ends of sentences.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
STAYS_TRUNCATED = 5
WHITE, ENDS = " \t\n\u000b\f\r", ".!?"
#: Rows and bytes of text of a block, whichever comes first.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
#: Rows that one task should solve, at about 50 microseconds each.
TASK_ROWS = 1 << 19

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after an inserted or renamed row, and the role that it has.
_STEP = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_ROLE = ("user", "user", "assistant", "user")
#: Least cost of a legal ending without further rows: two, one or no insertions.
_ENDING = (0, 10, 5, 0)
_INITIALS = {"s": 1, "u": 2, "a": 3}
#: State after a kept row by (initial, state).
_KEPT = {(1, START): AFTER_S, (2, START): AFTER_U, (2, AFTER_S): AFTER_U, (2, AFTER_A): AFTER_U, (3, AFTER_U): AFTER_A}
#: Kinds of rows: nothing wrong, must go, truncated.
FINE, GONE, CUT = range(3)


def _arcs(code: int) -> list[list[tuple[int, int, int]]]:
    """Edits of a row with that code (initial + 4 * kind) by state: (letter, cost, state after)."""
    initial, kind = code % 4, code // 4
    extra = STAYS_TRUNCATED if kind == CUT else 0
    out = []
    for s in range(4):
        edits = [(ord("D"), COST["D"], s)]
        if kind != GONE:
            if (initial, s) in _KEPT:
                edits.append((ord("K"), COST["K"] + extra, _KEPT[initial, s]))
            edits.append((ord("R"), COST["R"] + extra, _STEP[s]))
        out.append(edits)
    return out


ARCS = [_arcs(c) for c in range(12)]
_FAR = 1 << 40


def _insertions(best: list[int]) -> list[int]:
    """Costs by state when rows may be inserted first; more than two in a row never pay."""
    for _ in range(2):
        best = [min(b, COST["I"] + best[_STEP[s]]) for s, b in enumerate(best)]
    return best


def _matrix(code: int) -> np.ndarray:
    m = np.full((4, 4), _FAR, np.int64)
    for end in range(4):
        best = [min((c for _, c, t in ARCS[code][s] if t == end), default=_FAR) for s in range(4)]
        m[:, end] = _insertions(best)
    return m


_MATRICES = np.array([_matrix(c) for c in range(12)])
_NONE = np.where(np.eye(4, dtype=bool), 0, _FAR)


def block_matrix(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before the rows to each state after them; products in a tree."""
    m = _MATRICES[codes]
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, _NONE[None]])
        m = np.minimum((m[0::2, :, :, None] + m[1::2, None, :, :]).min(axis=2), _FAR)
    return m[0] if len(m) else _NONE


def costs_to_go(codes: list[int], ending: list[int]) -> list[list[int]]:
    """Cost DP from the last row to the first: per place and state the least cost of what is left."""
    out = [list(ending)]
    for code in reversed(codes):
        after = out[-1]
        out.append(_insertions([min(c + after[t] for _, c, t in edits) for edits in ARCS[code]]))
    return out[::-1]


def least_paths(blocks: list[tuple[list[int], list[int], bool]]) -> list[tuple[list[int], list[int], list[bytes]]]:
    """Per block (codes, costs of the ending by state, last of its conversation): costs to go, exit states, edit strings, each by entry state.

    Optimal arcs of all blocks are ranked together: the rank of an arc for 2 * k letters comes from its rank for k letters and
    that of the arc k steps on.  Arcs out of a node have different letters, so the least one leads the least string.
    """
    src, letter, dst, starts, togo = [], [], [], [], []
    base = 0
    exits: dict[int, int] = {}
    for codes, ending, last in blocks:
        h = costs_to_go(codes, ending)
        if last:  # insertions after the last row
            h.append([0, _FAR, _FAR, 0])
        n = len(codes)
        for i, code in enumerate(codes):
            for s, edits in enumerate(ARCS[code]):
                at, here = base + 4 * i + s, h[i][s]
                for name, c, t in edits:
                    if c + h[i + 1][t] == here:
                        src.append(at), letter.append(name), dst.append(base + 4 * (i + 1) + t)
                if COST["I"] + h[i][_STEP[s]] == here:
                    src.append(at), letter.append(ord("I")), dst.append(base + 4 * i + _STEP[s])
        for s in range(4):
            end = base + 4 * n + s
            if last and s in (AFTER_S, AFTER_U):
                src.append(end), letter.append(ord("I")), dst.append(base + 4 * n + _STEP[s])
            else:
                exits[end] = s
        starts.append(base)
        togo.append(h[0])
        base += 4 * (n + 1)
    # one arc stands for the end of a path: it has the least letter and leads to itself
    src, letter, dst = (np.array([*x, v], np.int64) for x, v in ((src, base), (letter, 0), (dst, base)))
    stop = len(src) - 1
    order = np.lexsort((letter, src))
    lead = np.full(base + 1, stop)
    lead[src[order[::-1]]] = order[::-1]  # the least letter is written last
    rank, hop = letter, lead[dst]
    pointers = [hop]
    longest = max((2 * len(codes) + 2 for codes, *_ in blocks), default=0)
    length = 1
    while length < longest:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[hop], return_inverse=True)[1]
        hop = hop[hop]
        pointers.append(hop)
        length *= 2
    order = np.lexsort((rank, src))
    lead[src[order[::-1]]] = order[::-1]
    out = []
    for (codes, *_), at, costs in zip(blocks, starts, togo, strict=True):
        places = np.arange(2 * len(codes) + 3)
        strings, ends = [], []
        for s in range(4):
            path = np.full(len(places), lead[at + s])
            for k, hops in enumerate(pointers):
                path = np.where(places >> k & 1, hops[path], path)
            path = path[: int(np.argmax(path == stop))]
            strings.append(letter[path].astype(np.uint8).tobytes())
            ends.append(exits[int(dst[path[-1]]) if len(path) else at + s])
        out.append((costs, ends, strings))
    return out


_BLOCKS = (
    "conv_id long, part int, seq long, codes binary, matrix array<long>, body binary, rows long, turns long, low long, high long, first_turn long,"
    " last_turn long, blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int"
)
_STATS = ("rows", "turns", "low", "high", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")
_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, dropped, fault, again) come sorted; blocks of rows of one conversation."""
    out, pack, part, seq = Batches(_BLOCKS), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0

    def block(conv_id, rows):
        nonlocal seq
        turns = [t for t, *_ in rows]
        known = [t for t in turns if t is not None]
        codes = np.array([_INITIALS.get(role[:1], 0) + 4 * (GONE if fault in ("blank", "duplicate") else CUT if fault else FINE) for _, role, _, fault in rows], np.int64)
        initial = (codes % 4).tolist()
        faults = [fault for *_, fault in rows]
        kept = [("", "") if fault in ("blank", "duplicate") else (role, text) for _, role, text, fault in rows]
        octets = [x.encode() for pair in kept for x in pair]
        body = np.array([len(x) for x in octets], "<u4").tobytes() + b"".join(octets)
        seq += 1
        return (
            conv_id, part, seq, codes.astype(np.uint8).tobytes(), block_matrix(codes).ravel().tolist(), pack.compress(body), len(rows), len(set(known)),
            known[0] if known else None, known[-1] if known else None, turns[0] if rows else None, turns[-1] if rows else None,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in _LEGAL for p in zip(initial, initial[1:])),
            initial[0] if rows else None, initial[-1] if rows else None,
        )

    for (conv_id,), group in groupby(arrow_rows(batches), itemgetter(slice(0, 1))):
        rows, octets, before, any_block = [], 0, None, False
        for _, turn, role, text, dropped, fault, again in group:
            if dropped:
                continue
            if fault != "blank" and (again or (turn, role, text) == before):
                fault = "duplicate"
            before = (turn, role, text)
            rows.append((turn, role, text, fault))
            octets += len(role) + len(text)
            if len(rows) >= BLOCK_ROWS or octets >= BLOCK_BYTES:
                if out.add(*block(conv_id, rows)):
                    yield out.take()
                rows, octets, any_block = [], 0, True
        if (rows or not any_block) and out.add(*block(conv_id, rows)):
            yield out.take()
    yield out.take()


_ENDINGS = "conv_id long, part int, seq long, codes binary, ending array<long>, last boolean"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, part, seq, codes, matrix) of a conversation come last first; each gets the costs of the best ending after it."""
    out = Batches(_ENDINGS)
    conv, best, last = None, None, True
    for conv_id, part, seq, codes, matrix in arrow_rows(batches):
        if best is None or conv_id != conv:
            conv, best, last = conv_id, np.array(_ENDING), True
        if out.add(conv_id, part, seq, codes, best.tolist(), last):
            yield out.take()
        best, last = (np.array(matrix).reshape(4, 4) + best).min(axis=1), False
    yield out.take()


_PATHS = "conv_id long, part int, seq long, tag int, costs array<long>, exits array<long>, edits array<string>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in any order; as many as have BLOCK_ROWS rows are ranked together."""
    out, held, size = Batches(_PATHS), [], 0

    def solved():
        found = least_paths([(list(codes), ending, last) for *_, codes, ending, last in held])
        for (conv_id, part, seq, *_), (costs, exits, edits) in zip(held, found, strict=True):
            out.add(conv_id, part, seq, 0, costs, exits, [e.decode() for e in edits])
        return out.take()

    for row in arrow_rows(batches):
        held.append(row)
        size += len(row[3]) + 1
        if size >= BLOCK_ROWS:
            yield solved()
            held, size = [], 0
    if held:
        yield solved()


_REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired_rows(state: int, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    """(state after, role, text) of each row that an edit string leaves or inserts."""
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            state = _KEPT[_INITIALS[role[0]], state]
        else:
            role, state = _ROLE[state], _STEP[state]
        yield state, role, text


def _unpacked(body: bytes, rows: int) -> Iterator[tuple[str, str]]:
    data = zstandard.ZstdDecompressor().decompress(body)
    at = 8 * rows
    sizes = iter(np.frombuffer(data, "<u4", 2 * rows).tolist())
    for role in sizes:
        text = next(sizes)
        yield data[at : at + role].decode(), data[at + role : at + role + text].decode()
        at += role + text


def _finish(texts: bool, ddl: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every block its paths (tag 0), then its rows (tag 1); blocks of a conversation in order."""
        out = Batches(ddl)
        for (conv_id,), group in groupby(arrow_rows(batches), itemgetter(slice(0, 1))):
            state, cost, audit, digest, lines, paths = START, None, [], hashlib.sha256(), [], None
            total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
            low = high = turn = initial = None
            started = False
            for _, tag, costs, exits, edits, body, *stats in group:
                if tag == 0:
                    paths = exits, edits
                    cost = costs[START] if cost is None else cost
                    continue
                s = dict(zip(_STATS, stats, strict=True))
                for name in total:
                    total[name] += s[name]
                if s["rows"]:
                    total["turns"] -= turn is not None and turn == s["first_turn"]
                    total["illegal"] += initial is not None and (initial, s["first_initial"]) not in _LEGAL
                    low = s["low"] if low is None else low
                    high = high if s["high"] is None else s["high"]
                    turn, initial = s["last_turn"], s["last_initial"]
                exits, edits = paths
                audit.append(edits[state])
                for _, role, text in repaired_rows(state, edits[state], _unpacked(body, s["rows"])):
                    digest.update(f"{'\n' if started else ''}{role}:{text}".encode())
                    started = True
                    if texts:
                        lines.append(f"{role}:{text}")
                state = exits[state]
            gaps = 0 if low is None else (high - low + 1 - total["turns"] + (1 << 63)) % (1 << 64) - (1 << 63)
            row = [conv_id, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, "".join(audit), digest.hexdigest()]
            if out.add(*row, *(["\n".join(lines)] if texts else [])):
                yield out.take()
        yield out.take()

    return run


def damaged(convs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows as the damage rule leaves them; dropped rows stay, marked, for their conversation's sake."""
    rows = convs.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("d", F.crc32(name) % 20)
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("dropped"), times).drop("col")


def intact(convs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The same columns of a table as it is."""
    text = {n: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for n, c in (("role", role_col), ("text", text_col))}
    return convs.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *text.values(), F.lit(False).alias("dropped"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Faults, then blocks of sorted rows.

    A row is a duplicate if its role and text were seen at an earlier turn (first turns by a partial minimum, no group of
    copies meets in one task) or stand in the row before it at the same turn.
    """
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(*ENDS), "truncated")
    rows = rows.withColumn("fault", fault)
    # nulls come first; a digest stands for role and text
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    who = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = rows.withColumn("who", F.when(~F.col("dropped") & ((F.col("fault") != "blank") | F.col("fault").isNull()), who)).withColumn("at", turn)
    seen = marked.where("who IS NOT NULL").groupBy("conv_id", "who").agg(F.min("at").alias("first"), F.max("at").alias("latest"))
    several = cut_lineage(seen.where("first < latest").select(F.col("conv_id").alias("c"), F.col("who").alias("w"), "first"))
    if several.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS:
        several = F.broadcast(several)
    joined = marked.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("who") == F.col("w")), "left")
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again")
    # heads of role and text split a turn that many rows share; the order inside a partition goes on with the whole texts
    heads = [F.substring("role", 1, 64).alias("role_head"), F.substring("text", 1, 64).alias("text_head")]
    order = ["conv_id", "turn", "role_head", "text_head"]
    dealt = joined.select("conv_id", "turn", "role", "text", "dropped", "fault", again, *heads).repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, "role", "text").drop("role_head", "text_head")
    return cut_lineage(dealt.mapInArrow(_cut, _BLOCKS))


def repaired(rows: DataFrame, texts: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired), a row per conversation.

    ``rows`` is what :func:`damaged` or :func:`intact` returns.  A null conversation id is one conversation; null turns come
    first; rows of one turn are ordered by role, then text (by their first 64 characters, then whole); null roles and texts are
    one space.  A role with another initial can only be renamed or deleted.  Gaps wrap around at 64 bits.  Identical rows meet in one task, as do
    the repaired rows of one conversation for its digest; both are streamed.  Without ``texts`` the repaired rows are not returned.
    """
    blocks = _blocks(rows)
    light = blocks.select("conv_id", "part", "seq", "codes", "matrix").repartition("conv_id")
    ended = light.sortWithinPartitions(F.asc("conv_id"), F.desc("part"), F.desc("seq")).mapInArrow(_endings, _ENDINGS)
    # blocks of one conversation are solved in different tasks; a fixed number of them, as few bytes take long here
    total = blocks.agg(F.sum("rows")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    paths = ended.repartition(tasks, "part", "seq").mapInArrow(_solve, _PATHS)
    bodies = blocks.select("conv_id", "part", "seq", F.lit(1).alias("tag"), "body", *_STATS)
    both = paths.unionByName(bodies, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "tag")
    ddl = _REPAIRED + (", repaired string" if texts else "")
    return both.select("conv_id", "tag", "costs", "exits", "edits", "body", *_STATS).mapInArrow(_finish(texts, ddl), ddl)


@query("op13_conversations")
def op13_conversations(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations")), texts=False)
