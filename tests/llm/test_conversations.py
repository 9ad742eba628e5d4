import hashlib
import heapq
import random
import re
import zlib

import pytest

from epochwise.llm import conversations as C

WORD = r"[^\x20\x09-\x0D]"


def hurt(rows):
    """The damage rule, written out; (conv, turn, role, text) with None for null."""
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(WORD, text)
        f = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(f)
    return out


def cheapest(rows, fault):
    """Least (cost, audit) by a search over (place, initials so far as far as they matter); cost first, then letters."""

    def grows(tail, c):
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[tail]

    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, tail, out = heapq.heappop(heap)
        if best.setdefault((i, tail), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and tail in ("", "a"):
            heapq.heappush(heap, (cost, audit, i + 1, tail, out))
            continue
        if i > len(rows):
            return cost, audit, out
        if len(audit) < 2 * len(rows) + 4:
            for role in ("user", "assistant"):
                if grows(tail, role[0]):
                    heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, (role, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, tail, out))
        if fault[i] in ("blank", "duplicate"):
            continue
        more = 5 if fault[i] else 0
        if role and grows(tail, role[0]):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
        for new in ("user", "assistant"):
            if grows(tail, new[0]):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new[0], (*out, (new, text))))


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r, x) for c, t, r, x in hurt(rows) if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = faults(mine)
        turns = [t for t, *_ in mine if t is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(mine, mine[1:])]
        cost, audit, left = cheapest(mine, fault)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))
        text = "\n".join(f"{r}:{x}" for r, x in left)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)
    return out


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None])
            text = rng.choice(["a b.", "a b", "same!", "same!", "x?\n", "", "\t\v", "é\x85", "ü. \xa0", None, f"text {rng.randrange(9)}."])
            rows.append((c if c else None, rng.choice([t, t, t + 3, None, 2]), role, text))
    return rows


def small_blocks(monkeypatch, rows):
    """Workers import the module anew, so the sizes go with the functions."""
    for name in ("_cut", "_solve"):

        def run(batches, name=name):
            from epochwise.llm import conversations

            usual, conversations.BLOCK_ROWS = conversations.BLOCK_ROWS, rows
            try:
                yield from getattr(conversations, name)(batches)
            finally:  # workers are used again
                conversations.BLOCK_ROWS = usual

        monkeypatch.setattr(C, name, run)


@pytest.mark.parametrize("size", [None, 1, 3])
def test_against_search(spark, monkeypatch, size):
    """Whole conversations, and the same cut into blocks of one and of three rows."""
    if size:
        small_blocks(monkeypatch, size)
    rows = made(1, 150, 12)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    frame = frame.withColumn("part", C.F.lit(1)).withColumn("who", C.F.lit("x"))
    got = {r.conv_id: tuple(r)[1:] for r in C.repaired(C.damaged(frame)).collect()}
    assert got == plain(rows)


def test_least_string_of_long_conversations():
    """Ranks against choosing the least letter at each step of the whole conversation."""
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 500, 3000):
        codes = [rng.randrange(12) for _ in range(n)]
        h = C.costs_to_go(codes, list(C._ENDING))
        state, i, audit = C.START, 0, []
        while i < n or state in (C.AFTER_S, C.AFTER_U):
            left = h[i][state]
            edits = [(chr(a), c, t, 1) for a, c, t in (C.ARCS[codes[i]][state] if i < n else [])] + [("I", 5, C._STEP[state], 0)]
            name, _, state, ahead = min(e for e in edits if e[1] + h[i + e[3]][e[2]] == left)
            audit.append(name)
            i += ahead
        costs, exits, strings = C.least_paths([(codes, list(C._ENDING), True)])[0]
        assert strings[C.START].decode() == "".join(audit) and costs == h[0] and exits[C.START] == state


def test_query_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in C.op13_conversations(spark, "/root/testdata/sf0.01").collect()}
    assert got == {c: v[:-1] for c, v in plain(rows).items()}


def test_one_long_conversation(spark):
    """A third of all rows in one conversation, cut into several blocks over several tasks; intact rows cost nothing."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t} " + "long " * 40 + ".") for t in range(20_000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"text {t}.") for c in range(2, 4000) for t in range(10)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = C._blocks(C.intact(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert marked.where("conv_id = 1").count() > 4 and marked.where("conv_id = 1").select("part").distinct().count() > 1
    got = {r.conv_id: r for r in C.repaired(C.intact(frame)).collect()}
    assert len(got) == 3999 and {(r.cost, r.illegal, r.gaps, r.duplicate) for r in got.values()} == {(0, 0, 0, 0)}
    assert got[1].audit == "K" * 20_000
    assert got[1].repaired == "\n".join(f"{r}:{x}" for c, _, r, x in rows if c == 1)


def test_edge_rows(spark):
    none = hashlib.sha256(b"").hexdigest()
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired(C.damaged(frame)).count() == 0
    rows = [(9, t, "user", "x.") for t in range(60)] + [(8, None, None, None), (8, 2**63 - 1, "assistant", "y."), (8, -(2**63), "user", "y" * 300_000 + ".")]
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "hello."))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.repaired(C.damaged(frame)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", none, "")
    want = plain([r for r in rows if r[0] == 9])[9]
    assert tuple(got[9])[1:] == want
    assert got[8].gaps == (2**64 - 2 + 2**63) % 2**64 - 2**63 and got[8].audit == plain([r for r in rows if r[0] == 8])[8][6]
