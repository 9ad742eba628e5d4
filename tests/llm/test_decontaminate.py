import random

import numpy as np

from epochwise.llm import decontaminate as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_equals_dynamic_programme():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(0, 90))]
        assert D.lcs(a, b) == plain_lcs(a, b)


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    dense = rng.standard_normal((30, 6)) @ rng.standard_normal((6, 40))
    rows = [(list(range(40)), r.tolist()) for r in dense]
    v = D.randomised_svd(spark.createDataFrame(rows, "terms array<long>, weights array<double>"), 40, 30, rank=6)
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-6)


def test_finds_every_verbatim_item_and_no_clean_text(spark):
    """Brute force: an item is in a document if its words are there in a row; other pairs must share most words in order."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: D.words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: D.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    inside = {(d, i) for d, w in docs.items() for i, x in items.items() if b" ".join(x) in b" ".join(w)}
    got = {(r.doc_id, r.item_id) for r in D.op2_decontaminate(spark, sf).collect()}
    assert inside and inside <= got
    for d, i in got - inside:
        assert plain_lcs(items[i], docs[d]) >= D.LCS_WITH_ANSWER * len(items[i])


def test_paraphrase_and_edges(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    item = [rng.choice(vocab) for _ in range(40)]
    para = [w for k, w in enumerate(item) if k % 9 != 4]
    noise = [" ".join(rng.choice(vocab) for _ in range(150)) for _ in range(20)]
    docs = [(i, t, "x") for i, t in enumerate(noise)] + [(50, noise[0] + " " + " ".join(para) + " " + noise[1], "x"), (51, None, "x"), (52, "", "x"), (None, " ".join(item), "x"), (50, " ".join(item).upper(), "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1), (None, "x y", 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id or -1, r.item_id) for r in D.matches(docs, bench).collect())
    assert got == [(-1, 7), (50, 7), (50, 7)]
    assert D.matches(docs, bench.limit(0)).count() == 0
    assert D.matches(docs.limit(0), bench).count() == 0


def test_blocks_give_the_same_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = {(r.doc_id, r.item_id) for r in D.op2_decontaminate(spark, sf).collect()}
    monkeypatch.setattr(D, "BLOCK", 32)
    assert {(r.doc_id, r.item_id) for r in D.op2_decontaminate(spark, sf).collect()} == whole


def test_blocks_hold_no_more_passages_than_the_rank(spark, monkeypatch):
    """Short items, then long ones next to each other, then one longer than a block; all are found, each once a row."""
    rng = random.Random(8)
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "RANK", 16)
    sizes, svd = [], D.randomised_svd
    monkeypatch.setattr(D, "randomised_svd", lambda m, terms, rows: sizes.append(rows) or svd(m, terms, rows, rank=16))
    made = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [(i, made(40)) for i in range(30)] + [(30 + i, ", ".join(made(1) for _ in range(48 * 7))) for i in range(4)] + [(40, made(48 * 12)), (41, made(48 * 40)), (42, "a,b," * 400)]
    noise = made(60)
    docs = [(i, f"{noise} {t} {noise}") for i, t in items] + [(41, f"{noise} {items[-2][1]} {noise}"), (99, noise)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert max(sizes) <= 16
    assert got == sorted([(i, i) for i, _ in items] + [(41, 41)])


def test_projection_takes_each_distinct_word_once():
    """The product of a window with a passage by way of the latent space, in long texts too, without a row for each word of the text."""
    rng = np.random.default_rng(5)
    terms = {f"w{k}".encode(): k for k in range(60)}
    idf, basis = rng.uniform(0.5, 3, 60), np.linalg.qr(rng.standard_normal((60, 12)))[0]
    cut = [rng.integers(0, 60, 40) for _ in range(12)]
    latent, norms = np.stack([(basis * idf[:, None])[c].sum(0) for c in cut]), np.array([np.sqrt((idf[c] ** 2).sum()) for c in cut])
    items = {i: ([b"w%d" % k for k in c], [b"w%d" % cut[i][-1]]) for i, c in enumerate(cut)}
    block = D._Block(terms, idf, basis, latent, norms, list(items), items)
    assert block.near.shape == (61, 12)
    text = [b"other"] * 3000 + items[4][0] + [b"other"] * 5000
    hits = {h[0]: h for h in block.search(b" ".join(text).decode())}
    at = hits[4][4]
    words = [terms[w] for w in text[at : at + D.WINDOW] if w in terms]
    window = (basis * idf[:, None])[words].sum(0) @ latent[4] / norms[4] / np.sqrt((idf[words] ** 2).sum())
    assert set(hits) == {4} and 3000 - D.WINDOW < at < 3040 and np.isclose(hits[4][1], window, atol=1e-5)
