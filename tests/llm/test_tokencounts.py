import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import tokencounts as C

RANKS = P.path("byte_bpe_50k.tiktoken")
COUNTER = C.Counter(RANKS, P.PATTERN)
TEXT = st.text(st.sampled_from("aabcd  \n\t'strevldm.,!9é日"), max_size=400)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), st.text(st.sampled_from("ab '\n se.9"), max_size=40)), max_size=4))
def test_edits_equal_full_encoding(text, edits):
    tree = C.build(COUNTER, text)
    for start, size, new in edits:
        n = len(tree.text)
        start = min(start, n)
        tree, _ = C.edit(COUNTER, tree, start, min(n, start + size), new)
        assert tree.total == len(COUNTER.model.encode_ordinary(tree.text))
        assert sum(map(sum, (a for a, _ in tree.leaves))) == len(tree.text)
        for a, b in zip(tree.sums, C._sums(tree.leaves), strict=True):
            assert (a == b).all()


def test_query_against_full_encoding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = C.op6_tokencounts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        a, b, new = C.middle_edit(t)
        assert r.n_tokens == len(COUNTER.model.encode_ordinary(t))
        assert r.n_tokens_edited == len(COUNTER.model.encode_ordinary(t[:a] + new + t[b:]))
        assert r.n_reencoded <= 0.2 * r.n_pretokens + 40


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (1, "word " * 40000, 1)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_pretokens) for r in C.counted(docs, RANKS, P.PATTERN).collect())
    assert got == [(0, 0), (1, 0), (1, 40001)]
    assert C.counted(docs.limit(0), RANKS, P.PATTERN).count() == 0
