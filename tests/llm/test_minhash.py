import random

import numpy as np

from moderata.llm import minhash
from tests.llm.conftest import prose


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    both, a, b = (np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (400, 60, 60))
    x, y = np.union1d(both, a), np.union1d(both, b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    same = (minhash.signature(x, 2000) == minhash.signature(y, 2000)).mean()
    assert abs(same - true) < 0.04


def test_cards_bound_overlaps():
    r = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 900, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        c = [np.frombuffer(minhash.card(v), np.uint8) for v in (x, y)]
        assert np.minimum(*c).sum() >= len(np.intersect1d(x, y))


def variants(seed=2):
    """Groups of near copies, copies, short texts and a large group changed to many degrees."""
    r = random.Random(seed)
    rows = []
    for g in range(12):
        words = prose(100 + g, 70).split()
        for _ in range(r.randint(1, 4)):
            w = list(words)
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"w{r.randrange(1000)}"
            rows.append(" ".join(w))
    words = prose(99, 60).split()
    for k in range(60):
        w = list(words)
        for _ in range(k // 8):
            w[r.randrange(len(w))] = f"v{r.randrange(1000)}"
        rows.append(" ".join(w))
    rows += ["", None, "a b", "A b", "a  b c", " ", "same same same same same"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    rows = variants()
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    plain = minhash.brute_force(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_odd_rows_and_columns(odd_docs, no_docs):
    out = minhash.keep_first(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [x.doc_id for x in out.select("doc_id").collect()]
    assert 2 not in ids and 12 not in ids and {1, 3, 4, 5, 6, 7, 9, 10, 11, None} <= set(ids)
    told = {x.doc_id: x for x in minhash.groups(odd_docs).collect()}
    assert told[3].n_shingles == told[4].n_shingles == told[5].n_shingles == 0
    assert told[7].n_shingles == 1 and told[2].component_id == 1 and told[None].kept
    assert minhash.groups(no_docs).count() == 0


def test_stage_equals_five_word_brute_force(spark):
    """The pipeline stage keeps what five-word sets keep, also where four-word sets would drop it."""
    import corpus_pipeline
    words = [f"w{k}" for k in range(60)]
    pair = [(i, " ".join(words[:at] + [f"z{i}"] + words[at + 1:])) for i, at in ((1000, 59), (1001, 30))]
    rows = variants() + pair
    four, five = minhash.brute_force(rows), minhash.brute_force(rows, 5)
    assert {i for i, (_, c) in four.items() if i == c} != {i for i, (_, c) in five.items() if i == c}
    out = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(i for i, (_, c) in five.items() if i == c)


def test_large_buckets_of_many_components(spark):
    """260 relatives of one text, around the threshold: one bucket holds linked and unlinked ones."""
    r = random.Random(12)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in r.sample(range(160), r.choice([1, 2, 4, 6, 7, 8, 9, 12])):
            words[at] = f"x{i}_{at}" if r.random() < 0.5 else f"y{at % 7}"
        rows.append((i, " ".join(words)))
    plain = minhash.brute_force(rows)
    assert 20 < len({c for _, c in plain.values()}) < 240
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (3, "other words", "a"), (3, "other words", "b"), (5, text, "a"), (None, "x", "a"), (None, "x", "a")]
    out = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, again string"))
    assert sorted((x.doc_id for x in out.collect()), key=str) == [1, 3, None, None]
