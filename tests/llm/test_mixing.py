from moderata.llm import mixing


def test_water_line_redistributes_among_siblings_first(spark):
    rows = [("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain0", "de", "c", 1000), ("domain1", "en", "d", 5)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"domain": {}, "lang": {}, "source": {}}
    got = {x.source: x.leaf_budget for x in mixing.budgets(leaves, 20, 1, weights).collect()}
    # 403 tokens: domain1 can hold 5 only, the rest goes to domain0; there a's shortage goes to b before de
    assert got["d"] == 5 and got["a"] == 10 and got["b"] == 189 and got["c"] == 199


def test_budget_is_met_and_prefixes_are_whole(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), ["en", "de"][i % 2], f"src{i % 5}") for i in range(400)],
                                 "doc_id long, text string, lang string, source string")
    rows = mixing.mix(docs).collect()
    leaves = {}
    for x in rows:
        leaves.setdefault((x.domain, x.lang, x.source), []).append(x)
    for own in leaves.values():
        used, tokens = sum(x.copies * x.n_tokens for x in own), sum(x.n_tokens for x in own)
        assert used <= own[0].leaf_budget <= mixing.EPOCHS * tokens
        assert own[0].leaf_budget - used < 8  # at most the document that did not fit
    assert {x.doc_id: x.copies for x in mixing.mix(docs.repartition(7)).collect()} == {x.doc_id: x.copies for x in rows}
    taken = mixing.selected(docs).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in taken} == {x.doc_id: x.copies for x in rows if x.copies}


def test_odd_rows_and_columns(odd_docs, no_docs):
    out = mixing.selected(odd_docs, percent=100, epochs=1)
    assert out.columns == odd_docs.columns
    assert {x.doc_id for x in out.collect()} >= {1, 2, 6, 7, 8, 9, 10, 11, None}
    told = mixing.mix(odd_docs).collect()
    assert len(told) == odd_docs.count()
    assert {x.copies for x in told if x.n_tokens == 0 and x.doc_id == 4} == {0}
    assert mixing.mix(no_docs).count() == 0
