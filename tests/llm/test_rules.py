import hashlib
import random

import numpy as np
import pytest

from moderata.llm import licenses, outliers, pii, vptree
from tests.conftest import SF01


def names(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_license_matches_equal_brute_force(spark):
    r = random.Random(1)
    words = "licensed under the apache license version 2 0 mit general public gnu 3 this work is all rights reserved Copyright x".split()
    texts = [" ".join(r.choice(words) + r.choice(["", ".", ",", "-"]) for _ in range(r.randint(0, 40))) for _ in range(250)]
    texts += ["Licensed under the Apache License, Version 2.0.", "MIT-License mit  license", "", None, "émit license",
              "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
              "Copyright (c) 2020 Foo. All rights reserved.", "licensed under big apache license version 2 0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in licenses.scanned(docs).collect():
        assert tuple(x)[1:] == licenses.brute_force(texts[x.doc_id]), texts[x.doc_id]


def test_license_odd_rows(odd_docs, no_docs):
    rows = licenses.scanned(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(x.n_words, x.labels, x.first_word, x.score) for x in rows if x.doc_id in (3, 4, 5)} == {(0, "", None, 0.0)}
    assert [x.n_words for x in rows if x.doc_id == 6] == [40_000]
    assert licenses.scanned(no_docs).count() == 0


def test_outliers_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    plain = outliers.brute_force([(x.doc_id, x.text, x.lang, x.source) for x in docs.collect()])
    rows = outliers.judged(docs).collect()
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) \
            == tuple(plain[x.doc_id][:7])
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    good = [x for x in rows if labels.get(x.doc_id) == 1 and not x.base_failed]
    bad = [x for x in rows if labels.get(x.doc_id) == 0]
    assert sum(x.kept for x in good) / len(good) > 0.99 and sum(x.kept for x in bad) / len(bad) < 0.2


def test_outliers_odd_rows(odd_docs, no_docs):
    rows = outliers.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    plain = outliers.brute_force([(i, x.text, x.lang, x.source) for i, x in enumerate(odd_docs.collect())])
    assert sorted((x.n_words, x.n_repeat_words, x.n_dup_lines, x.kept) for x in rows) \
        == sorted((p[0], p[4], p[3], p[6]) for p in plain.values())
    assert outliers.judged(no_docs).count() == 0


def test_base_spans_equal_plain_regex(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("a.@ +-()0123456789%bc\n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c.d@e.f", "x@y.z_q@r.s a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 +1 (456) 555-2186", None, "",
              "1" * 20_000, "a" * 20_000 + "@b.c", "+" + "1 " * 9000, "999.1.2.3 0001.02.3.255", "\U0001d518 a@b.cd 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.found(docs).collect():
        plain = pii.brute_base(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(names(plain).encode()).hexdigest(), texts[x.doc_id]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == i for _, k, _ in plain) for i in range(4))
        assert set(names(plain).split(",")) <= set(x.spans.split(","))


def test_patterns_of_seeds_discover_unseen_identifiers(spark):
    """Badge numbers stand where e-mail addresses stand; counts in clean text stand elsewhere."""
    rows = [(k, f"please contact user{k:03d}@mail{k % 9}.example.com for access") for k in range(60)]
    rows += [(100 + k, f"please contact badge-{7000 + k * 13}-x for access") for k in range(5)]
    rows += [(200 + k, f"it weighs {10 ** 9 + k} grams in all") for k in range(5)]
    rows += [(300, "please contact 4111111111111112 for access")]  # fails the Luhn sum: known not to be a card
    got = {x.doc_id: x.spans for x in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k] == f"id:15:{15 + len(rows[60 + k][1].split()[2])}" for k in range(5))
    assert all(got[200 + k] == "" for k in range(5)) and got[300] == ""
    assert all(got[k].startswith("email:15:") and "id:" not in got[k] for k in range(60))


def test_every_base_match_is_a_seed(spark):
    """E-mails without a digit, spaced cards and phones, short addresses; short and spaced identifiers in their places."""
    rows = [(k, f"write to {'abcdefghij'[k % 10]}{'klmnop'[k // 10]}.smith@example.com, before noon") for k in range(60)]
    rows += [(100 + k, f"write to kx{k}-uvw, before noon") for k in range(5)]
    rows += [(200 + k, f"dial +49 30 12345{k:02d} or wait") for k in range(9)] + [(220, "dial 0800 12 34 or wait")]
    rows += [(300, "pay with 4111 1111 1111 1111 today"), (301, "host 1.2.3.4 is up")]
    got = {x.doc_id: (x.spans, x.n_spans) for x in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k] == ("id:9:16", 1) for k in range(5))
    assert got[220] == ("id:5:15", 1) and got[301] == ("ip:5:12", 1) and got[300][0] == "card:9:28"
    assert {k: x for k, (x, _) in got.items()} == pii.brute_spans(rows)


def test_pattern_graph_equals_plain_version(spark):
    r = random.Random(5)
    slot = ["call", "id", "see", "to", "post:", "Ref", "(no.", "\n"]
    what = ["a.b@c.de", "x1@y.org", "10.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (456) 555-2186", "A-12", "b7,",
            "12 34 5", "--9--", "77", "word", "KX-55.", "ab_3;c", "é7è", "1\t2", "..", "7/7"]
    rich = lambda: r.choice(["", "mail " + r.choice(["a.b@c.de"] * 60 + what) + r.choice([" now", "; now", " (today)"])])
    texts = [" ".join([r.choice(slot if n % 2 else what) for n in range(r.randrange(1, 9))] + [rich()]) for _ in range(250)] + [None, "", "7" * 3000,
             "-" * 3000 + "7" + "-" * 3000, "x" * 6000 + " 1"]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.spans for x in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = pii.brute_spans(rows)
    assert got == plain and any("id:" in x for x in plain.values())


def test_pii_odd_rows(odd_docs, no_docs):
    rows = pii.found(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    x = next(x for x in rows if x.doc_id == 10)
    assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == (1, 1, 1, 1)
    assert {x.spans for x in rows if x.doc_id in (3, 4, 5)} == {""}
    assert pii.found(no_docs).count() == 0


def plain_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % vptree.QUERY_STEP == 0:
            d = sorted((float(vptree.distances(v[None], q)[0]), j) for j, v in good if j != i)[:k]
            out[i] = [(j, s) for s, j in d]
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(10_000, 10_000), (150, 3)])
def test_nearest_equal_brute_force(spark, shard_rows, block_rows):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(150)]  # one very common vector: ties
    rows += [(900, None), (1000, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (None, [1.0] * 6), (1300, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in vptree.nearest(table, shard_rows=shard_rows, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert x["rank"] == len(got[x.query_id])
    assert got == plain_nearest(rows, vptree.K)


def test_larger_factor_keeps_recall(spark):
    table = spark.read.parquet(f"{SF01}/embeddings.parquet")
    exact = {(x.query_id, x.vec_id) for x in vptree.nearest(table).collect()}
    rough = {(x.query_id, x.vec_id) for x in vptree.nearest(table, factor=1.2).collect()}
    assert len(exact & rough) / len(exact) >= 0.9


def test_no_queries_or_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert vptree.nearest(table).count() == 0 and vptree.nearest(table.where("false")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in vptree.nearest(few).collect()] == [(0, 1, 2)]


def test_nearest_within_every_size(spark):
    """Vectors of several sizes, repeated ids, clashing columns, distances beyond the largest double."""
    rows = [(0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0, 4.0]), (2, [1.0, 2.5]), (3, [2.0, 2.0]), (4, [0.5, 1.0]),
            (4, [0.5, 1.5]), (200, [1e200, 1e200, 0.0, 0.0]), (5, [-1e308, -1e308, 1.0, 0.0])]
    table = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<double>, shard int, d int")
    got = {}
    for x in vptree.nearest(table, shard_rows=2, block_rows=1).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {0: [1], 100: [2, 4, 3, 4], 200: [5]}
