import corpus_pipeline as C
from moderata.llm import lines, minhash, mixing
from moderata.llm.common import written
from tests.conftest import SF001


def test_stages_against_plain_versions(spark):
    """Each stage's rows equal the plain version on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    stages = dict(C.STAGES)
    good = written(stages["quality_classifier"](spark, docs, SF001), "t1")
    assert good.columns == columns and 0.7 < good.count() / docs.count() < 1

    told = lines.brute_force([(x.doc_id, x.text) for x in good.collect()])
    slim = written(stages["line_dedup"](spark, good, SF001), "t2")
    assert slim.columns == columns
    kept = {x.doc_id: x.text for x in slim.collect()}
    assert kept == {i: t for i, (n, e, r, t) in told.items() if not (e + r) or t.strip()}
    assert all(x.n_chars == len(x.text) for x in slim.collect())

    first = written(stages["minhash_near_dedup"](spark, slim, SF001), "t3")
    plain = minhash.brute_force(list(kept.items()))
    assert sorted(x.doc_id for x in first.collect()) == sorted(i for i, (_, c) in plain.items() if i == c)

    mixed = written(stages["mixing_to_weights"](spark, first, SF001), "t4")
    plan = {x.doc_id: x.copies for x in mixing.mix(first, percent=C.BUDGET_PERCENT, epochs=1).collect()}
    assert mixed.columns == columns
    assert sorted(x.doc_id for x in mixed.collect()) == sorted(i for i, c in plan.items() if c)

    last = stages["sentencepiece_encoding"](spark, mixed, SF001).collect()
    assert len(last) == mixed.count() and all(x.lossless for x in last)


def test_run_and_registration(spark):
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    out = E.queries()["pipeline"](spark, SF001)
    assert out.columns == ["doc_id", "n_tokens", "ids", "lossless"] and out.count() > 50


def test_python_stages_take_few_rows_at_a_time(spark):
    """A worker holds a few hundred documents; the session's setting comes back after a run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    try:
        for name in ("quality_classifier", "minhash_near_dedup", "sentencepiece_encoding"):
            spark.conf.set(key, 10_000)
            dict(C.STAGES)[name](spark, docs, SF001)
            assert int(spark.conf.get(key)) <= 500, name
        spark.conf.set(key, 100)
        dict(C.STAGES)["sentencepiece_encoding"](spark, docs, SF001)
        assert spark.conf.get(key) == "100"
        spark.conf.set(key, 7_000)
        C.run(spark, SF001)
        assert spark.conf.get(key) == "7000"
    finally:
        spark.conf.set(key, before)
