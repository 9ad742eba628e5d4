import random

import numpy as np

import corpus_pipeline as C
from epochwise.llm import jaccard as K


def words(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    """Smallest id reachable by pairs of similarity 0.8 or more."""
    sets = {i: words(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, j in enumerate(ids):
        for i in ids[:n]:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_stage_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    root = brute(texts)
    assert {r.doc_id for r in C.drop_near_copies(spark, docs, "").collect()} == {i for i, r in root.items() if i == r}
    near = [1 for i, r in root.items() if i != r and words(texts[i]) != words(texts[r])]
    assert near


def test_recall_of_pairs_at_each_similarity(spark):
    """Copies with some words replaced, from just below to far above the bound; a large group around one text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = {}
    for k in range(150):
        base = [word() for _ in range(rng.choice((60, 200)))]
        other = base.copy()
        for at in rng.sample(range(len(base)), rng.randint(0, len(base) // 35 + 1)):
            other[at] = word()
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
    base = [word() for _ in range(150)]
    for k in range(200):
        own = base.copy()
        for at in rng.sample(range(150), rng.randint(1, 5)):
            own[at] = word()
        texts[1000 + k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in K.near_copies(docs).collect()}
    want = brute(texts)
    assert got == want and 20 < sum(want[2 * k + 1] == 2 * k for k in range(150)) < 150


def test_grown_joins_what_chains_of_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sets = [np.unique(rng.choice(40, 30)).astype(np.uint64) for _ in range(25)]
        root = list(range(25))
        find = lambda x: x if root[x] == x else find(root[x])
        for i in range(25):
            for j in range(i):
                if alike(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6:
                    root[find(i)] = find(j)
        want = {frozenset(j for j in range(25) if find(j) == find(i)) for i in range(25)}
        for i in range(25):
            root[i] = i
        for a, b in K.grown(sets, 0.6):
            root[find(a)] = find(b)
        assert {frozenset(j for j in range(25) if find(j) == find(i)) for i in range(25)} == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "One two  three"), (None, "one two three"), (5, "word " * 70000), (6, "one two four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in K.near_copies(docs).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5), (6, 6)]
    assert K.near_copies(docs.limit(0)).count() == 0


def test_cut_keys_lose_no_link(spark, monkeypatch):
    """One template in a third of the rows, keys cut into many blocks: one component, chains over blocks, and a member apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {}
    for k in range(90):
        own = base.copy()
        for at in rng.sample(range(120), rng.randint(1, 4)):
            own[at] = word()
        texts[k] = " ".join(own)
    # each text of a chain is like the next one only; most share keys with the template
    own = base.copy()
    for k in range(100, 130):
        own[(k - 100) * 4] = word()
        texts[k] = " ".join(own)
    for k in range(200, 300):
        texts[k] = " ".join(word() for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    for wide, cells in ((8, K.CELLS), (K.WIDE, 1500)):
        monkeypatch.setattr(K, "WIDE", wide)
        monkeypatch.setattr(K, "CELLS", cells)
        assert {r.doc_id: r.component_id for r in K.near_copies(docs).collect()} == want


def test_members_outside_the_largest_component_meet_every_block(spark, monkeypatch):
    """Heads are not alike, their members are: the links are found by the last step."""
    monkeypatch.setattr(K, "WIDE", 4)
    shared = [f"s{i}" for i in range(400)]
    texts, at = {}, 0
    for k in range(24):  # a long chain: neighbours at 0.8 or more, texts further apart are not
        own = shared.copy()
        own[at : at + 36] = [f"t{k}w{i}" for i in range(36)]
        at += 8
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in K.near_copies(docs).collect()} == brute(texts)


def test_fingerprints_within_three_bits_share_a_key(spark):
    """The ball hashing of op1 finds candidates: exactly the texts joined by steps of 3 bits or fewer have a key in common."""
    from epochwise.llm import simhash as S

    base = [f"w{k}" for k in range(4000)]
    texts = [" ".join(base), " ".join([*base[:2000], "other", *base[2001:]]), " ".join(reversed(base)), "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.marked(docs, "doc_id", "text", 5).cache()
    fps = {r.doc_id: r.fp for r in rows.collect()}
    assert fps == {i: S.simhash(t, 5) for i, t in enumerate(texts)}
    assert 0 < ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= S.RADIUS
    keys = {r.mark: r.key for r in K.ball_keys(rows).collect()}
    mark = {r.doc_id: r.mark for r in rows.collect()}
    assert len(keys) == 4 and keys[mark[0]] == keys[mark[1]] and len(set(keys.values())) == 3
