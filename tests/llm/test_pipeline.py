import corpus_pipeline as C
from epochwise.llm import decontaminate as D
from epochwise.llm import toxicity as T
from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    texts = []
    for k, (name, stage) in enumerate(C.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "pieces":
            assert docs.columns == columns
        gone = set(before) - set(after)
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            model = T.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
            odds = T.log_odds(model, [r.text for r in before.values()])
            assert gone == {i for i, o in zip(before, odds, strict=True) if o >= 0}
            bad = {r.doc_id for r in labels.collect() if r.toxic}
            assert len(gone - bad) <= 0.1 * len(before)
        if name == "near_copies":
            root = brute({i: r.text for i, r in before.items()})
            assert gone == {i for i, r in root.items() if i != r} and gone
        if name == "decontamination":
            items = [b" ".join(D.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {i for i, r in before.items() if any(x in b" ".join(D.words_of(r.text)) for x in items)}
            assert held <= gone and len(gone - held) <= 2
        if name == "personal_data":
            assert not gone
            for i, r in after.items():
                assert (r.text == before[i].text) or plain_pii(before[i].text)
                assert not any(k in ("email", "ip") for *_, k in plain_pii(r.text))
        if name == "pieces":
            assert {i: r.decoded for i, r in after.items()} == {i: r.text for i, r in before.items()}
        texts.append(len(after))
        before = after
    assert texts[0] > 100


def test_rows_without_id_and_empty_tables(spark):
    rows = [(1, None, "en", "a", 0), (1, "same words in a row here now", "en", "a", 0), (None, "x", "en", "a", 0), (2, "same words in a row here now", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.drop_near_copies(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("1", "same words in a row here now"), ("None", "x")]
    assert len(kept) == 3  # the row without a text is no copy of the other with its id
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_toxicity_stage_rejects_what_op8_predicts(spark):
    """The same rows as op8; of the held-out toxic rows at least 92 % go, of the clean ones less than 2 %."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in T.op8_toxicity(spark, sf).collect()}
    kept = {r.doc_id for r in C.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if not r.predicted}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(i not in kept, t) for i, t in truth.items() if rows[i].held_out]
    assert sum(g and t for g, t in held) >= 0.92 * sum(t for _, t in held)
    assert sum(g and not t for g, t in held) < 0.02 * sum(not t for _, t in held)


def test_shared_and_missing_ids_lose_and_damage_nothing(spark):
    """Different texts under one id stay and keep their own words; rows without an id are redacted as others are."""
    near = " ".join(f"word{k}" for k in range(60))
    rows = [(1, near), (1, "a text about other things that is no copy of it at all"), (1, near), (2, near + " more"), (None, near), (None, "a text without an id of its own")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text) for r in C.drop_near_copies(spark, docs, SF).collect())
    assert kept == sorted([("1", near), ("1", rows[1][1]), ("None", rows[5][1])])
    # "write to" is learned from addresses of the fixed form and reaches one that is not
    known = [(10 + k, f"please write to user{k}@host{k}.example.org today") for k in range(40)]
    rows = [*known, (5, "please write to user78@host98 today"), (5, "an entirely different clean text of the same id, with more words"), (None, "please write to user79@host99 today")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.text for r in C.mask_personal_data(spark, docs, SF).collect()}
    assert got == {"please write to [EMAIL] today", "an entirely different clean text of the same id, with more words"}
