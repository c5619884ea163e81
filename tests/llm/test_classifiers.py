import numpy as np
import pytest

from moderata.llm import langid, quality
from tests.conftest import SF01
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    rows = (quality.score_quality(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect())
    assert sum(x.predicted == x.quality for x in rows) / len(rows) > 0.95
    good = [x.score for x in rows if x.quality == 1]
    bad = [x.score for x in rows if x.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)


def test_quality_gradients():
    r = np.random.default_rng(0)
    x, ptr, y = r.normal(size=(12, quality.N_FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    before = quality.forward(quality.learn(x, ptr, y, epochs=1), x, ptr)["p"]
    after = quality.forward(quality.learn(x, ptr, y, epochs=200), x, ptr)["p"]
    loss = [-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() for p in (before, after)]
    assert loss[1] < 0.1 < loss[0]


def test_passages_cover_whole_texts():
    text = prose(1, 64 * 10) + " " + "ZZZ " * 64
    x, owner = quality.passages([text, None, ""])
    assert len(x) == 11 and set(owner) == {0} and x[-1][0] > 0.9 > x[0][0]


def test_quality_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (9, 0), (8, 1), (8, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    rows = quality.score_quality(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= x.score <= 1 for x in rows)
    assert len({x.score for x in rows if x.doc_id in (3, 4, 5)}) == 1
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns
    assert quality.score_quality(no_docs, model).count() == 0
    assert quality.fit(no_docs, labels) == {"constant": 0.5}


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    rows = (langid.identified(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect())
    assert sum(x.lang_pred == x.lang for x in rows) / len(rows) > 0.98


def test_code_lengths_equal_plain_ppm():
    rows = [("a", prose(1, 60)), ("b", "zig zag zoo zen " * 12), ("a", prose(2, 40))]
    model = langid.learn(rows)
    for text in ("river stone", "zig 日 12 Zoo", prose(9, 20)):
        got = langid.bits(model, [text, None, text])
        plain = [langid.brute_force_bits(rows, text, lang) for lang in model["langs"]]
        assert np.allclose(got[0], plain, rtol=1e-5) and np.allclose(got[2], got[0])


@pytest.mark.parametrize("most", [0, 1, 4, 30])
def test_contexts_are_bounded_per_language(most):
    """A language of few texts keeps its own contexts beside one of many."""
    rows = [("a", prose(k, 200)) for k in range(6)] + [("b", "zig zag zoo zen " * 12)]
    model = langid.learn(rows, most)
    assert len(model["table"]) <= model["size"] ** 2 + 2 * most
    for text in ("river stone", "zig zag zoo", prose(9, 20)):
        got = langid.bits(model, [text])[0]
        assert np.allclose(got, [langid.brute_force_bits(rows, text, lang, most) for lang in model["langs"]], rtol=1e-5)


def test_long_texts_teach(spark):
    """A language found only in texts beyond the bound is learned, from passages of the whole text, within the bound."""
    rows = [(k, prose(k, 300), "a") for k in range(20)]
    rows += [(100 + k, "zig zag zoo zen " * 3000 + "quux quip " * 3000, "b") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(langid.sample(docs.where("lang = 'b'")))
    assert langid.MAX_CHARS <= len(got["b"]) + langid.PASSAGE <= langid.MAX_CHARS + 2 * langid.PASSAGE
    assert "zig" in got["b"] and "quux" in got["b"]
    told = langid.identified(spark.createDataFrame([(1, "zoo zen zig quip"), (2, "river of stone")], "doc_id long, text string"), langid.fit(docs))
    assert {x.doc_id: x.lang_pred for x in told.collect()} == {1: "b", 2: "a"}


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = {x.doc_id: x for x in langid.identified(odd_docs, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (3, 4, 5))
    assert rows[1].lang_pred in model["langs"] and 0 < rows[1].score <= 1
    assert langid.fit(no_docs) is None
    assert {x.lang_pred for x in langid.identified(odd_docs, None).collect()} == {"und"}
    assert langid.identified(no_docs, model).count() == 0
