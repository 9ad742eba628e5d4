import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import bytededup as B
from epochwise.llm import repeats as R
from epochwise.llm import worddedup as W


def brute(rows, n):
    """rows: (id, tokens).  Per row the tokens that go."""
    low = {}
    for i, t in rows:
        for k in range(len(t) - n + 1):
            g = t[k : k + n]
            low[g] = min(low.get(g, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - n + 1):
            if low[t[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        out.append(gone)
    return out


def check_bytes(rows, got):
    want = {}
    for (i, t), gone in zip(rows, brute(rows, 50), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


def check_words(rows, got):
    split = [(i, tuple(t.split())) for i, t in rows]
    want = {}
    for (i, t), gone in zip(split, brute(split, 13), strict=True):
        kept = b" ".join(w for w, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize(("group", "hot"), [(8 << 20, R.HOT), (60_000, 2)])
def test_queries_against_brute_force(spark, monkeypatch, group, hot):
    monkeypatch.setattr(R, "HOT", hot)  # windows under nearly all shared triggers travel one by one
    monkeypatch.setattr(R.Repeats.__init__, "__defaults__", (group,))
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_bytes(rows, B.op3_bytededup(spark, sf).collect())
    check_words(rows, W.op4_worddedup(spark, sf).collect())


@pytest.mark.parametrize("hot", [1, 12, 10_000])
def test_hot_passages_small_alphabets_and_borders(spark, monkeypatch, hot):
    """A passage in every third document, runs of one letter, windows of exactly the length at both ends."""
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R.Repeats.__init__, "__defaults__", (4_000,))
    rng = random.Random(2)
    hot = "".join(rng.choice("ab ") for _ in range(120))
    words = " ".join(rng.choice("xyz") for _ in range(13))
    texts = []
    for i in range(90):
        own = "".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(0, 300)))
        kind = i % 6
        texts.append([own, hot + own, own + hot[:50], own[:20] + hot[10:90] + own, "a" * rng.randrange(45, 120), words + own[:9] + " " + words][kind])
    rows = [(i * 3 - 7, t.encode()) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    check_bytes(rows, B.without_repeats(docs).collect())
    check_words(rows, W.without_repeats(docs).collect())


def test_edges(spark):
    long = "é" * 100 + " one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (2, long, 1), (2, long, 1), (None, "q", 1), (3, long, 1)], "doc_id long, text string, chunk int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in B.without_repeats(docs).collect())
    n = len(long.encode())
    assert got == [(0, 1, 0), (1, 0, 0), (1, 0, 0), (2, n, 0), (2, n, 0), (3, n, n)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in W.without_repeats(docs).collect())
    assert got == [(0, 1, 0, "q"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 14, 0, long), (2, 14, 0, long), (3, 14, 14, "")]
    for op in (B, W):
        assert op.without_repeats(docs.limit(0)).count() == 0


def test_text_longer_than_a_piece(spark):
    """A document that is hashed alone, with the whole of a small one inside it."""
    rng = random.Random(5)
    small = " ".join(f"s{rng.randrange(10**6)}" for _ in range(40))
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(120_000))
    at = long.index(" ", R.PIECE) + 1
    docs = spark.createDataFrame([(1, small), (2, long[:at] + small + " " + long[at:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in B.without_repeats(docs).collect()}
    assert got[1][0] == 0
    # the blank after the small text is in no window of it
    assert got[2] == (len(small), 1, (long[:at] + " " + long[at:]).encode())
    got = {r.doc_id: (r.n_removed, r.kept) for r in W.without_repeats(docs).collect()}
    assert got == {1: (0, small), 2: (40, long)}


def runs_of(flags):
    return [(k, next((j for j in range(k, len(flags)) if not flags[j]), len(flags)) - 1) for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1])]


def wanted(sequences, ids, n):
    low = {}
    for t, i in zip(sequences, ids, strict=True):
        for k in range(len(t) - n + 1):
            low[tuple(t[k : k + n])] = min(low.get(tuple(t[k : k + n]), i), i)
    return [(c, *r) for c, (t, i) in enumerate(zip(sequences, ids, strict=True)) for r in runs_of([low[tuple(t[k : k + n])] < i for k in range(len(t) - n + 1)])]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.text("abc", min_size=13, max_size=40), st.integers(-5, 5)), min_size=1, max_size=6), st.sampled_from([1, 2, 3, 5, 8, 13]))
def test_automata_and_suffix_arrays_against_brute_force(rows, n):
    """Also empty bytes of value zero (a for 0) and equal ids; a second shard has no part in the first."""
    texts, ids = [t for t, _ in rows], [i for _, i in rows]
    low, size = np.array(ids, np.int64), np.array([len(t) for t in texts])
    raw = [t.encode().replace(b"a", b"\0") for t in texts]
    of, a, b = B.by_suffix_array(raw, size - n, low, np.zeros(len(texts), np.int64), n)
    assert sorted(zip(of.tolist(), a.tolist(), b.tolist(), strict=True)) == wanted(raw, ids, n)
    words = [" ".join(t).encode() for t in texts]
    of, a, b = W.by_automata(words * 2, np.tile(size - n, 2), np.tile(low, 2), np.repeat([0, 1], len(texts)), n)
    once = wanted(texts, ids, n)
    assert sorted(zip(of.tolist(), a.tolist(), b.tolist(), strict=True)) == once + [(k + len(texts), x, y) for k, x, y in once]


def test_matching_statistics_stay_at_the_window_length():
    """Long common runs do not hide that the last n words alone are known from a smaller document."""
    shard = W.Automaton([b"x a b c".split(), b"y x a b c d".split(), b"z a b c d".split()], [3, 2, 1])
    assert shard.repeated(b"y x a b c d".split(), 2, 3) == [(2, 3)]
    assert shard.repeated(b"x a b c".split(), 3, 3) == [(0, 1)]
    assert shard.repeated(b"z a b c d".split(), 1, 3) == []


def test_triggers_against_brute_force(monkeypatch):
    """Each window is served by the leftmost of the smallest high halves of its grams' hashes, whatever stands before or after it."""
    mix = R.mix
    monkeypatch.setattr(R, "mix", lambda h: (mix(h) % np.uint64(7)) << np.uint64(32) | mix(h) >> np.uint64(32))  # ties in plenty
    rng, n, w = np.random.default_rng(2), 9, 4
    lengths = np.array([0, 40, 3, 0, 9, 8, 200, 30, 0])
    tokens = rng.integers(1, 5, lengths.sum()).astype(np.uint64)
    p = R.phrases(tokens, lengths, n, w)
    got = {s: (d, t) for d, a, b, t in zip(p.doc, p.first, p.last, p.trigger, strict=True) for s in range(a, b + 1)}
    want, begin = {}, 0
    for d, size in enumerate(lengths):
        for s in range(begin, begin + size - n + 1):
            grams = [p.rolling.stretch(np.array([k]), np.array([k + w]))[0] for k in range(s, s + n - w + 1)]
            want[s] = (d, min(grams, key=lambda h: h >> np.uint64(32)))
        begin += size
    assert got == want and len(want) > 200
    assert R.powers(10) is R.powers(20)
