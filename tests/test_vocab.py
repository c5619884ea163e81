"""BPE learning and encoding on Spark equal a plain-Python BPE on sf0.001."""
from collections import Counter

import duckdb
import regex
from pyspark.sql import functions as F

from conftest import SF001
from moderata.operators import vocab as VO
from moderata.sources import tables as TB

W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"
WORD = regex.compile(rf"[{W}]+|[^{W}\x09-\x0D\x20\x85\p{{Z}}]+")
N_MERGES = 24
N_MERGES_LONG = 160


def py_texts():
    return [t for (t,) in duckdb.sql(
        f"SELECT text FROM '{SF001}/documents.parquet' ORDER BY doc_id").fetchall()]


def py_bpe(texts, n):
    words = Counter(w for t in texts for w in WORD.findall(t))
    segs = {w: list(w) for w in words}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, c in words.items():
            s = segs[w]
            for a, b in zip(s, s[1:]):
                pairs[(a, b)] += c
        if not pairs:
            break
        (a, b), cnt = min(pairs.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        merges.append((a, b, cnt))
        for w, s in segs.items():
            out, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            segs[w] = out
    return words, merges


def test_word_counts_match_python(spark):
    words, _ = py_bpe(py_texts(), 0)
    got = {r.word: r.n for r in VO.word_counts(TB.table(spark, SF001, "documents")).collect()}
    assert got == dict(words)


def test_merges_match_python(spark):
    _, expected = py_bpe(py_texts(), N_MERGES)
    words = VO.word_counts(TB.table(spark, SF001, "documents"))
    got = VO.learn_merges(spark, words, N_MERGES, checkpoint_every=5)
    assert got == expected


def test_encoding_matches_python(spark):
    texts = py_texts()
    words, merges = py_bpe(texts, N_MERGES)
    alpha = sorted({ch for w in words for ch in w})
    vocab = VO.vocabulary(alpha, merges)
    ranks = {(a, b): i for i, (a, b, _) in enumerate(merges)}
    expect = [[vocab[s] for w in WORD.findall(t) for s in VO.bpe_word(w, ranks)] for t in texts]
    enc = VO.encoder(spark, alpha, merges)
    df = TB.table(spark, SF001, "documents").orderBy("doc_id")
    got = [r.ids for r in df.select(enc(VO.pretokens(F.col("text"))).alias("ids")).collect()]
    assert got == expect
    tail = df.select(VO.tail_ids(enc(VO.pretokens(F.col("text"))), 128).alias("t")).collect()
    assert [r.t for r in tail] == [e[-128:] for e in expect]
    assert vocab["[UNK]"] == 0 and vocab["[PAD]"] == 3


def test_batched_rounds_equal_sequential_bpe(spark):
    """Many merges: rounds take several merges at once, results stay exact."""
    _, expected = py_bpe(py_texts(), N_MERGES_LONG)
    words = VO.word_counts(TB.table(spark, SF001, "documents"))
    assert VO.learn_merges(spark, words, N_MERGES_LONG) == expected
    one_by_one = VO.learn_merges(spark, words, 40, candidates=1, band_words=0)
    assert one_by_one == expected[:40]


def test_bands_of_words_equal_sequential_bpe(spark):
    """Both ways of a round, mixed and alone, down to the rarest pairs: the merges stay the same."""
    _, expected = py_bpe(py_texts(), 100)
    words = VO.word_counts(TB.table(spark, SF001, "documents")).checkpoint()
    for band_words, merges in ((0, 12), (2_500, 60), (8_000, 100)):
        assert VO.learn_merges(spark, words, merges, band_words=band_words) == expected[:merges], band_words


def test_a_token_made_twice_ends_a_band(spark):
    """(a, bc) and (ab, c) both make abc: pairs with abc then lie outside the band's words too."""
    words = spark.createDataFrame([("abcx", 50), ("abx", 70), ("bcy", 90), ("abcy", 9), ("zabc", 30)], "word string, n long")
    plain = [(r.word, r.n) for r in words.collect()]
    want = VO._Band([{"word": w, "n": n, "syms": VO.SEP.join(w)} for w, n in plain], 1, whole=True)
    merges = want.take(12, set())
    for band_words in (0, 3, 6, 100):
        assert VO.learn_merges(spark, words, 12, band_words=band_words) == merges[:12], band_words


def test_vocab_query_layout(spark):
    import __spark_entry__ as E
    rows = E.queries()["bpe_vocab"](spark, SF001).orderBy("id").collect()
    toks = [r.token for r in rows]
    assert [r.id for r in rows] == list(range(len(rows)))
    assert toks[:5] == ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
    merges = E.queries()["bpe_merges"](spark, SF001).orderBy("rank").collect()
    tail = list(dict.fromkeys(m.token for m in merges))  # first occurrence keeps its id
    assert toks[-len(tail):] == tail


def test_one_tokeniser_for_learning_encoding_and_reports(spark):
    """Unicode blanks part words; superscripts and fractions are no word characters."""
    from moderata.functions.columns import tokens, words
    from moderata.operators import scoring as SC
    texts = ["sorry\u00a0toxic a\u3000b", "x\u2028y\u0085z", "m\u00b2 x\u00bd \u2167", "na\u00efve_1, ok!? \u0001ab", "a\u001cb", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "message_id long, text string").orderBy("message_id")
    assert [r.t for r in df.select(tokens(F.col("text")).alias("t")).collect()] == [WORD.findall(t) for t in texts]
    assert [r.t for r in df.select(words(F.col("text")).alias("t")).collect()] == [t.split() for t in texts]
    assert [r.tokens for r in SC.token_list(df).collect()] == [", ".join(WORD.findall(t)) for t in texts]
    assert WORD.findall(texts[2]) == ["m", "\u00b2", "x", "\u00bd", "\u2167"]


def test_words_with_the_separator_are_counted(spark):
    words = spark.createDataFrame([("ab", 5), ("\u0001ab", 9), ("\u0002\u0001", 4)], "word string, n long")
    got = VO.learn_merges(spark, words, 3)
    assert got == [("a", "b", 14), ("\u0001", "ab", 9), ("\u0002", "\u0001", 4)]
    pairs = {(r.left, r.right): r["count"] for r in VO.pair_counts(VO.initial_symbols(words)).collect()}
    assert pairs == {("a", "b"): 14, ("\u0001", "a"): 9, ("\u0002", "\u0001"): 4}


def test_rounds_are_few_and_equal_sequential_bpe(spark, monkeypatch):
    """Words with many frequent pairs: a round takes dozens of merges, whatever the number of words."""
    rounds = []
    take = VO._Band.take
    monkeypatch.setattr(VO._Band, "take", lambda self, most, known: rounds.append(take(self, most, known)) or rounds[-1])
    _, expected = py_bpe(py_texts(), 300)
    words = VO.word_counts(TB.table(spark, SF001, "documents")).checkpoint()
    assert VO.learn_merges(spark, words, 300, band_words=words.count() // 2) == expected
    assert len(rounds) <= 12, [len(x) for x in rounds]


def test_cut_words_equal_sequential_bpe():
    """Words cut at rare pairs, tokens made in several ways: every width of the band gives the same merges."""
    import random

    for seed in range(300):
        rnd = random.Random(seed)
        words = {"".join(rnd.choices("abcd"[:rnd.randint(1, 4)], k=rnd.randint(2, 10))): rnd.randint(1, 40) for _ in range(30)}
        want = VO._Band([{"syms": VO.SEP.join(w), "n": n} for w, n in words.items()], 1, whole=True).take(40, set())
        got, known, state = [], set(), [(list(w), n) for w, n in words.items()]
        width, listed = rnd.choice([1, 2, 4, 9]), rnd.choice([4, 1000])
        while len(got) < len(want):
            counts = Counter()
            for s, n in state:
                for p in zip(s, s[1:]):
                    counts[p] += n
            ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
            floor = ranked[listed][1] if len(ranked) > listed else 0
            ranked = ranked[:listed]
            least = max(ranked[min(width, len(ranked)) - 1][1], floor + 1)
            band = {p for p, c in ranked if c >= least} or {ranked[0][0]}
            most = len(want) - len(got) if least <= ranked[0][1] else 1
            pieces = Counter()
            for s, n in state:
                start = 0
                for i in range(1, len(s) + 1):
                    if i == len(s) or (s[i - 1], s[i]) not in band:
                        pieces[VO.SEP.join(s[start:i])] += n if i - start > 1 else 0
                        start = i
            rows = [{"syms": s, "n": n} for s, n in pieces.items() if n]
            outside = {p: c for p, c in ranked if p not in band}
            taken = VO._Band(rows, min(least, ranked[0][1]), False, band, outside, floor).take(most, known)
            assert taken
            steps = {}
            for i, (a, b, _) in enumerate(taken):
                steps.setdefault((a, b), []).append(i)
            state = [(VO._replayed(s, steps), n) for s, n in state]
            got += taken
        assert got == want, seed
