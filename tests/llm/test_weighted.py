import hashlib
import random

import pytest

from epochwise.llm import weighted as W


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(4)
    s = W.Sampler(2048)
    for share in (0.2, 0.5, 0.9):
        a = {f"t{i}": rng.choice([1, 1, 2, 5]) for i in range(80)}
        b = {k if rng.random() < share else k + "x": v if rng.random() < 0.7 else v + 2 for k, v in a.items()}
        keys = a.keys() | b.keys()
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        assert abs(W.likeness(s.signature(a), s.signature(b)) - exact) < 0.05


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_query_against_brute_force(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in W.fingerprints(docs, group_bytes=size).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    s = W.Sampler()
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, r = texts[i], rows[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[j][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == W.likeness(s.signature(W.terms(t)), s.signature(W.terms(texts[j])))
        assert r.near_edited == W.likeness(s.signature(W.terms(t)), s.signature(W.terms(edited)))
    assert len({(texts[i], rows[i].fingerprint) for i in texts}) == len(set(texts.values()))


def test_edges(spark):
    docs = spark.createDataFrame([(5, "abcd ef", 1), (5, None, 1), (None, "zz yy", 1), (9, "", 1)], "doc_id long, text string, key int")
    got = sorted(((r.doc_id or -1, r.n_chars, r.edited) for r in W.fingerprints(docs).collect()))
    assert got == [(-1, 5, "zz "), (5, 0, ""), (5, 7, "abcd"), (9, 0, "")]
    one = W.fingerprints(spark.createDataFrame([(1, "ab cd", 1)], docs.schema)).collect()
    assert [(r.edited, r.near_next) for r in one] == [("ab ab", 1.0)]
    assert W.fingerprints(docs.limit(0)).count() == 0
