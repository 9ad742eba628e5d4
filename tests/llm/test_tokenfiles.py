import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochwise.llm import tokenfiles as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, raw = T.pack(ids)
    assert T.unpack(words, raw, len(ids)).tolist() == values
    block = T.to_block([1], [len(ids)], ids)
    assert T.from_block(block)[2].tolist() == values
    assert T.id_range(block, 3, 20).tolist() == values[3:20]


def test_ranges_over_offsets():
    ids = np.arange(40_000, dtype=np.uint64) * 7 % 50_021
    block = T.to_block([1], [len(ids)], ids)
    for lo, hi in ((0, 5), (5_000, 5_003), (9_990, 31_000), (39_999, 40_000)):
        assert T.id_range(block, lo, hi).tolist() == ids[lo:hi].tolist()


def test_words_equal_whole_texts(spark):
    model = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["It's I'LL we've, <|endoftext|> x<|startoftext|>y ..., ,. a\x1cb a b c 日本語。 é ́e İx Ǆa 12,3 ß. ÀÉ, ﬁ _-_", None, "", " \t\n"]
    got = [np.frombuffer(x, "<u4").tolist() for x in T.words(PATH).encode(texts)]
    assert got == [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_BYTES", 50_000)
    sf = "/root/testdata/sf0.001"
    model = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in T.op9_tokenfiles(spark, sf).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*model.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens) == (at, len(ids))
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(5, None, 1), (5, "a b", 1), (None, "c", 1), (1, "word " * 30000, 1)], "doc_id long, text string, part int")
    T.write(docs, f"file://{tmp_path}/a", PATH)
    got = [(r.doc_id, r.start, len(r.ids) // 4) for r in T.read(spark, f"file://{tmp_path}/a").orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 30001), (5, 30003, 1), (5, 30004, 3)]
    T.write(docs.limit(0), f"file://{tmp_path}/b", PATH)
    assert T.read(spark, f"file://{tmp_path}/b").count() == 0


def test_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 40)
    own = T.Words(PATH)
    texts = [" ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}" for j in range(30)) for i in range(100)]
    assert own.encode(texts) == T.words(PATH).encode(texts)
