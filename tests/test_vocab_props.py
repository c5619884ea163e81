"""Property tests: BPE merge and pair extraction on arbitrary symbols
(regex metacharacters, backslashes, dollars, non-ASCII) equal plain Python."""
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moderata.operators import vocab as VO

ALPHABET = list("ab$\\.^*+?()[]{}|é🎉-")
symbols = st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=3).map("".join)
words = st.lists(symbols, min_size=1, max_size=8)


def py_merge(seq, a, b):
    out, i = [], 0
    while i < len(seq):
        if i < len(seq) - 1 and seq[i] == a and seq[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


@settings(max_examples=30, deadline=None)
@given(cases=st.lists(st.tuples(words, symbols, symbols), min_size=1, max_size=20))
def test_apply_merge_and_pairs_match_python(spark, cases):
    rows = [(i, VO.SEP.join(seq), a, b) for i, (seq, a, b) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, syms string, a string, b string").collect()
    got_merge, got_pairs = {}, {}
    for r in df:  # one literal pattern per case, as learn_merges builds them
        one = spark.createDataFrame([(r.syms,)], "syms string")
        out = one.select(VO.apply_merge(F.col("syms"), r.a, r.b).alias("m"),
                         F.regexp_extract_all("syms", F.lit(VO.PAIR_PATTERN), 1).alias("p"))
        row = out.collect()[0]
        got_merge[r.i], got_pairs[r.i] = row.m, row.p
    for i, (seq, a, b) in enumerate(cases):
        assert got_merge[i] == VO.SEP.join(py_merge(seq, a, b))
        expect = [x + VO.SEP + y for x, y in zip(seq, seq[1:])]
        assert Counter(got_pairs[i]) == Counter(expect)
