import hashlib
import random

import pytest

from epochwise.llm import fim as M


def plain(doc_id, t):
    """The contract, written out."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b])


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def check(rows, docs):
    want = sorted((str((*p[:5], sha(p[5]), sha(t), p[5])) for i, x in docs for t in [x or ""] for p in [plain(i, t)]))
    assert sorted(str(tuple(r)) for r in rows) == want


def test_restored_inverts_every_arrangement():
    rng = random.Random(3)
    for i in range(3000):
        t = "".join(rng.choice("<PSM>aé ") for _ in range(rng.randrange(12)))
        form, parts = M.arranged(i, t)
        out = "".join(p if isinstance(p, str) else t[p[0] : p[1]] for p in parts)
        assert M.restored(out, form) == t and out == plain(i, t)[5]


@pytest.mark.parametrize("chunk", [M.CHUNK, 7])
def test_rows_against_brute_force(spark, monkeypatch, chunk):
    """Small pieces too: marks and parts then lie in many pieces.  Repeated rows, null and shared ids, clashing columns."""
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("<>PSMab é😀\n") for _ in range(rng.choice([0, 1, 2, 30, 200])))) for i in range(150)]
    docs += [(3, None), (None, "a null id"), (None, None), (7, "one id"), (7, "two texts"), *[(9, "the same row " * 9)] * 40]
    docs += [(11, "long é😀 " * 40_000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, mark string, at int").repartition(5)
    if chunk != M.CHUNK:  # workers import the module anew, so the size goes with the function

        def run(batches):
            from epochwise.llm import fim

            usual, fim.CHUNK = fim.CHUNK, chunk
            try:
                yield from fim._emit(batches)
            finally:  # workers are used again
                fim.CHUNK = usual

        monkeypatch.setattr(M, "_emit", run)
        docs = docs[:-1]
        frame = frame.where("doc_id <> 11 OR doc_id IS NULL")
        docs = [d for d in docs if d[0] != 11]
    check(M.transformed(frame).collect(), docs)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = M.op11_fim(spark, "/root/testdata/sf0.001").collect()
    want = {(*p[:5], sha(p[5]), sha(t or "")) for i, t in docs for p in [plain(i, t or "")]}
    assert {tuple(r) for r in rows} == want and len(rows) == len(docs)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.transformed(docs).columns[-1] == "output" and M.transformed(docs).count() == 0
