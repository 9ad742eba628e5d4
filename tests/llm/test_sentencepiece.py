import hashlib
import itertools

import numpy as np

from epochwise.llm import sentencepiece as S


def every(p, s):
    """All segmentations of a short text with their scores."""
    if not s:
        return [(0.0, ())]
    out = []
    for n in range(1, len(s) + 1):
        head = s[:n]
        if head in p.score:
            v = p.score[head]
        elif n == 1:
            v = p.spelled * len(head.encode())
        else:
            continue
        out += [(v + x, (*p.ids(head), *rest)) for x, rest in every(p, s[n:])]
    return out


def test_n_best_against_enumeration():
    p = S.pieces(S.default_model())
    for t in ("a", "hello", "the cat", "a  b", "né\nx", "日本!", "go to"):
        want = sorted(every(p, S.SPACE + t.replace(" ", S.SPACE)), key=lambda x: -x[0])
        for n in (1, 2, 3, 5):
            ids, scores, others = p.encode(t, n)
            assert np.allclose(scores, [w[0] for w in want[:n]])
            got = [tuple(np.frombuffer(x, "<u4").tolist()) for x in (ids, *others)]
            assert len(set(got)) == len(got) == len(scores)
            known = {w[1]: w[0] for w in want}
            assert np.allclose([known[g] for g in got], scores)
        assert [x[0] for x in p.n_best(S.SPACE + "hello", 6)] == sorted((x[0] for x in p.n_best(S.SPACE + "hello", 6)), reverse=True)


def test_a_text_leaves_the_pieces_of_a_longer_one():
    """What was learned at the end of a text must not hide longer pieces, in either order."""
    for words in (("year", "years"), ("years", "year")):
        p = S.Pieces(S.default_model())
        for t in words:
            want = sorted(every(p, S.SPACE + t), key=lambda x: -x[0])[: S.N_BEST]
            ids, scores, others = p.encode(t)
            assert np.allclose(scores, [w[0] for w in want])
            assert [tuple(np.frombuffer(x, "<u4").tolist()) for x in (ids, *others)] == [w[1] for w in want]
    fresh = S.Pieces(S.default_model())
    p = S.Pieces(S.default_model())
    longer = [t for t in p.score if t.isalpha() and len(t) > S.AHEAD]
    for t in longer:
        p.forward(t[: S.AHEAD])
    for t in longer:
        fresh.starts.clear()
        assert p.forward(t)[0] == fresh.forward(t)[0]


def test_round_trip_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = S.op7_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    for r in itertools.islice(rows, 20):
        assert r.n_pieces > 0 and len(r.scores) == S.N_BEST and list(r.scores) == sorted(r.scores, reverse=True)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "  \t\n 😀 end ", 1), (4, "word " * 50000, 1)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.decoded) for r in S.encoded(docs, S.default_model()).collect()}
    assert got == {(1, ""), (None, "  \t\n 😀 end "), (4, "word " * 50000)}
    assert S.encoded(docs.limit(0), S.default_model()).count() == 0


def test_table_of_segments_is_bounded(monkeypatch):
    p = S.Pieces(S.default_model())
    monkeypatch.setattr(S, "KEPT", 50)
    for i in range(300):
        p.encode(f"w{i} x{i * 7}")
        assert len(p.kept) <= 50


def test_segments_solved_together_are_those_solved_alone(spark):
    """The same ids, scores and distances to the last bit, whatever the order; those with a character without a piece are left to ``solve``."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "日本! né\n\n  x😀y", "a" * 200]
    p, alone = S.Pieces(S.default_model()), S.Pieces(S.default_model())
    every = sorted({s for t in texts for s in p.cut(t)})
    got = dict(p.solve_all(every))
    assert len(got) > 0.9 * len(every) and "\n" in every and "\n" not in got
    assert all(alone.solve(s) == answer for s, answer in got.items())
    assert list(p.encode_all(texts)) == [alone.encode(t) for t in texts]
    assert p.solve_all([]) == p.solve_all(["\n"]) == []


def test_frequent_segments_outlive_a_full_table(monkeypatch):
    p, solved = S.Pieces(S.default_model()), []
    forward = S.Pieces.forward
    monkeypatch.setattr(S, "KEPT", 50)
    monkeypatch.setattr(S.Pieces, "forward", lambda self, s: solved.append(s) or forward(self, s))
    for i in range(300):
        p.encode(f"the w{i} x{i * 7}", 1)
        assert len(p.kept) + len(p.older) <= 50
    assert solved.count(S.SPACE + "the") == 1
    for few in (10, 200):  # the table takes all of a piece's segments or fewer
        monkeypatch.setattr(S, "KEPT", few)
        assert list(p.encode_all(["the old man and the sea", "a new man and an old sea " * 9])) == [p.encode(t) for t in ("the old man and the sea", "a new man and an old sea " * 9)]
