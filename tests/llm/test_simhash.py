import numpy as np
import xxhash

from epochwise.llm import simhash as S


def plain(text, size=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(marks):
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_equals_definition():
    for t in (None, "", " \n", "A", "a B", "the cat sat", "É the\tCAT sat on\nthe the the cat sat on", "x " * 500):
        assert S.simhash(t) & (2**64 - 1) == plain(t)


def test_all_links_within_three_bits(spark):
    """Random centres with members at every distance from 0 to 5, in both halves."""
    rng = np.random.default_rng(5)
    marks = []
    for _ in range(60):
        c = int(rng.integers(0, 2**63))
        marks.append(c)
        for d in range(6):
            x = c
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            marks.append(x)
    marks = {i: m for i, m in enumerate(dict.fromkeys(marks))}
    signed = {m - (1 << 64) if m >> 63 else m: i for i, m in marks.items()}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {i: i for i in marks}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in S.links(fps).collect():
        x, y = sorted((find(signed[a]), find(signed[b])))
        got[y] = x
    assert {i: find(i) for i in marks} == brute(marks)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = S.op1_simhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {i: plain(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute(marks)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "one two three four", "z"), (3, "one two three four", "z"), (None, "one two three four", "q"), (5, "word " * 70000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
