"""Spelling variants, periodic runs and collision-counting vectors against plain versions and odd rows."""
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moderata.llm import collisions as C
from moderata.llm import periods as P
from moderata.llm import spelling as S


# ---------------------------------------------------------------- spelling

def _variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df).collect()}


def test_spelling_equals_brute_force(spark, odd_docs):
    r = random.Random(3)
    base = ["".join(r.choice("abàé") for _ in range(r.randrange(7, 10))) for _ in range(120)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(50):
            w = r.choice(base[:int(1 + 119 * r.random() ** 3)])
            if r.random() < .2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abà") + w[k:], w[:k] + r.choice("bé") + w[k + 1:]])
            words.append(w.upper() if r.random() < .1 else w)
        rows.append((i, " ".join(words)))
    rows += [(None, "abababab " * 3), (5000, None), (5001, ""),
             (5002, " ".join(["x" * 3000, "x" * 3000, "x" * 2999, "x" * 2999]))]
    rows += [(x.doc_id, x.text) for x in odd_docs.collect()]
    got, want = _variants(spark.createDataFrame(rows, "doc_id long, text string")), S.brute_force(rows)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and max(v[3] for v in want.values()) > 3


def test_trie_nodes_are_numbered_alike_in_all_tasks(spark):
    words = sorted({"".join(w) for w in np.random.default_rng(1).choice(list("ab"), (400, 9))})
    df = spark.createDataFrame([(1, w) for w in words], "key long, word string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = S.numbered(df, "nodes").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    nodes = {}
    for row in rows:
        for k, node in enumerate(row["path"]):
            assert nodes.setdefault(row["word"][:k + 1], node) == node
    assert len(set(nodes.values())) == len(nodes)
    assert len({r["path"][-1] >> S.COUNTER_BITS for r in rows}) > 3  # several tasks took part
    last = [r["path"][-1] for r in sorted(rows, key=lambda r: r["word"])]
    assert last == sorted(last)  # a word's own number follows the words' order


def test_spelling_on_odd_and_empty_tables(odd_docs, no_docs):
    assert set(_variants(odd_docs)) == set(S.brute_force([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert S.variants(no_docs).count() == 0


# ---------------------------------------------------------------- periodic runs

sequence = st.lists(st.integers(0, 2), max_size=60)


@settings(max_examples=300, deadline=None)
@given(sequence, st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(0, 9), sequence)
def test_runs_equal_brute_force(before, root, times, after):
    words = before + root * times + after
    numbers = np.array(words, np.int64)
    other = np.array([0, 0, 0, 0, 0, 0, 1], np.int64)
    got = P.runs_of_texts([other, numbers, numbers])
    want = P.brute_force(words)
    assert [tuple(r) for r in got[1].tolist()] == want == [tuple(r) for r in got[2].tolist()]
    assert got[0].tolist() == [[0, 6, 1]]


def test_long_periods_and_every_scale():
    r = np.random.default_rng(4)
    for period in (1, 3, 4, 7, 8, 15, 16, 17, 100, 513):
        root = r.integers(0, 5, period)
        if period > 1:
            root[0] = 9  # primitive
        words = np.concatenate([r.integers(10, 400, 50), np.tile(root, 6)[:max(6, 4 * period + period // 2)], r.integers(10, 400, 50)])
        got = P.runs(words.astype(np.int64)).tolist()
        assert [50, max(6, 4 * period + period // 2), period] in got
        assert got == [list(x) for x in P.brute_force(words.tolist())]


def _plain_answer(doc_id, text):
    import re
    import zlib
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = P.brute_force(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_runs_of_documents(spark, odd_docs, no_docs):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 120)))) for i in range(150)]
    rows += [(x.doc_id, x.text) for x in odd_docs.collect() if len(x.text or "") < 50_000]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"),):
        got = P.runs_per_document(df).collect()
        assert len(got) == len(rows)
        told = sorted(((x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256,
                        x.collapsed_sha256) for x in got), key=str)
        assert told == sorted(((i, *_plain_answer(i, t)) for i, t in rows), key=str)
        assert sum(x.n_runs > 0 for x in got) >= 10
    assert P.runs_per_document(odd_docs).count() == odd_docs.count()
    assert P.runs_per_document(no_docs).count() == 0


# ---------------------------------------------------------------- vectors

def _clusters(n, size, seed):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((n // 5, size))
    x = centre[r.integers(0, len(centre), n)] + r.standard_normal((n, size)) * r.choice([.2, .33, .4], (n, 1))
    return x.astype(np.float32)


def _linked(df, **more):
    return {r.vec_id: (r.n_links, r.component_id) for r in C.groups(df, **more).collect()}


def test_vectors_recall(spark):
    x = _clusters(3000, 24, 1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = C.brute_force(rows)
    for block in (C.BLOCK, 200):
        got = _linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block)
        total = sum(n for n, _ in want.values())
        assert total > 2000 and sum(min(got[i][0], want[i][0]) for i in want) >= 0.99 * total
        assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold, none twice
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_cells_keep_recall(monkeypatch):
    """With cells forced, the calibrated tables bring nearly all pairs at the threshold together."""
    monkeypatch.setattr(C, "COPY_COST", 1)
    r = np.random.default_rng(2)
    x = C.unit(r.standard_normal((2000, 48)))
    m = C.calibrated(x, 1_000_000)
    assert m["bits"] >= 8 and m["tables"] > 10
    w = r.standard_normal(x.shape)
    w = C.unit(w - (w * x).sum(axis=1)[:, None] * x)
    y = C.COSINE * x + np.sqrt(1 - C.COSINE**2) * w
    on, splits = C.directions(48, 1, m["bits"] * m["tables"]), np.array(m["splits"])
    same = ((C.projected(x, on) > splits) == (C.projected(y, on) > splits)).reshape(len(x), m["tables"], m["bits"]).all(axis=2)
    assert same.any(axis=1).mean() > 0.98


def test_collisions_are_counted_by_windows():
    x = C.unit(np.random.default_rng(3).standard_normal((60, 16)))
    on, width, least = C.directions(16, 2, C.WINDOWS), C.spread(C.COSINE), C.needed()
    v = C.projected(x, on)
    a, b = C.collided(x, on, width, least)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (np.abs(v[i] - v[j]) <= width).sum() >= least}
    assert set(zip(a.tolist(), b.tolist())) == want and want


def test_vectors_odd_rows(spark):
    one, two = [1.0, 0.0, 0.1], [0.0, 2.0, 0.0]
    rows = [(5, one), (3, one), (3, one), (9, [2 * c for c in one]), (7, two), (8, None), (11, []), (12, [0.0, 0.0, 0.0]),
            (13, [1.0, None, 0.0]), (14, [1.0, float("nan"), 0.0]), (15, [float("inf"), 0.0, 0.0]), (None, one),
            (16, [1.0, 0.0]), (17, [1.0, 0.01]), (18, [0.0, 2.0, -0.0]), (20, [1e300, 1e300, 0.0]), (21, [1e300, 1e300, 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows[:-2] if kind == "float" else rows, f"vec_id long, embedding array<{kind}>")
        for c in ("id", "v", "d1", "d2", "copies", "n_links", "size"):
            df = df.withColumn(c, F.lit(c))
        got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in C.groups(df).collect()]
        assert len(got) == df.count()
        told = {g[0]: g[1:] for g in got}
        assert told[3] == (2, 3, True) and told[5] == (2, 3, False) and told[9] == (2, 3, False)
        assert got.count((3, 2, 3, True)) == 2
        assert told[7] == (1, 7, True) and told[18] == (1, 7, False)
        assert told[16] == (1, 16, True) and told[17] == (1, 16, False)
        for i in (8, 11, 12, 13, 14, 15):
            assert told[i] == (0, i, True)
        assert told[None] == (0, None, True)
        if kind == "double":
            assert told[20] == (1, 20, True) and told[21] == (1, 20, False)
    assert C.groups(df.where("false")).count() == 0
