import zlib

from epochwise.llm import toxicity as T


def test_grams_stay_inside_words():
    (_, n, doc, bucket), *rest = T.grams(["ab cd", None, "abcdef"])
    assert n == 3 and not rest
    # " ab", "ab ", " ab ", " cd", "cd ", " cd " and two words; of the long word: 3-, 4-, 5-grams with both ends
    assert [int((doc == i).sum()) for i in range(3)] == [8, 0, 6 + 5 + 4 + 1]
    again = next(T.grams(["abcdef"]))
    assert sorted(again[3].tolist()) == sorted(bucket[doc == 2].tolist())


def test_misspelling_shares_its_grams():
    good = [f"a calm word number {i} here" for i in range(60)]
    bad = [f"you are worthless number {i} here" for i in range(60)]
    model = T.fit(good + bad, [0] * 60 + [1] * 60, 0.5)
    a, b, c = T.log_odds(model, ["so worthlesss here", "a calm place", ""])
    assert a > 0 > b and abs(c - model.bias) < 1e-9
    assert T.fit([], [], 0.1).bias < 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in T.op8_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i].predicted, t) for i, t in truth.items() if rows[i].held_out]
    hit = sum(p and t for p, t in held) / sum(t for _, t in held)
    wrong = sum(p and not t for p, t in held) / sum(not t for _, t in held)
    print("recall", hit, "false positives", wrong)
    assert hit > 0.9 and wrong < 0.02


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "word " * 200000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(docs, none)
    got = T.scored(docs, model).collect()
    assert len(got) == 3 and all(r.score < 0.5 for r in got)
    assert T.scored(docs.limit(0), model).count() == 0
