"""BPE vocabulary learning and encoding on Spark.

Learning (T5)
  1. one pass over the corpus: pre-tokenise (words or punctuation runs) and
     ``groupBy(word).count()`` -- a hash aggregate with partial aggregation;
  2. every later step works on the *distinct* words with their counts. A round
     counts the adjacent pairs, collects the top of their ranking (count desc,
     then left, right; a ``limit``, no global sort), cuts every word where a
     pair is rarer than the round's least count and groups equal pieces: a
     merge of the round can only happen inside a piece, and there are few
     different pieces, however many words. All merges down to the least count
     are found among them (``_Band``) -- the result equals one merge at a time.
     The words are then rewritten with the round's merges, one narrow pass.
  The words are checkpointed every few rounds (files under the session's
  ``spark.checkpoint.dir``), so a lost executor recomputes at most a few rounds
  and plans stay small.

Encoding (T6)
  The learned merges are bounded by the vocabulary size parameter, so they
  are shipped to the executors as a broadcast variable; a pandas UDF applies
  them per word (rank-ordered merging) with a per-batch cache.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import SPECIAL_TOKENS
from ..functions.columns import WORD_PATTERN, tokens

SEP = "\u0001"  # symbol separator inside a word's symbol string
ESC = "\u0002"  # escapes the separator and itself inside symbols
CHAR_PATTERN = "(?s)."  # one code point
MAX_VOCAB = 2_000_000  # merges + alphabet shipped to executors: bounded by this
CACHED_WORDS = 200_000  # words whose ids a task keeps
BAND_WORDS = 100_000  # different pieces of words that one round of learning handles together
RANKED = 16_384  # top of the pair ranking that a round looks at


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """T5 step 1: (word, n) over the whole corpus."""
    return (texts.select(F.explode(tokens(F.col(text), WORD_PATTERN)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def escaped(s: Column) -> Column:
    """A symbol without the separator: U+0002 and U+0001 become U+0002 b and U+0002 a (order is kept)."""
    return F.replace(F.replace(s, F.lit(ESC), F.lit(ESC + "b")), F.lit(SEP), F.lit(ESC + "a"))


def unescaped(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit(ESC + "a"), F.lit(SEP)), F.lit(ESC + "b"), F.lit(ESC))


def _plain(s: str) -> str:
    return s.replace(ESC + "a", SEP).replace(ESC + "b", ESC)


def initial_symbols(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, n, syms): the word's code points joined by SEP."""
    chars = F.regexp_extract_all(F.col("word"), F.lit(CHAR_PATTERN), 0)
    return words.withColumn("syms", F.array_join(F.transform(chars, escaped), SEP))


# Every "left SEP right" pair, captured by a zero-width match at each symbol start.
PAIR_PATTERN = f"(?:^|(?<={SEP}))(?=([^{SEP}]+{SEP}[^{SEP}]+))"


def _pairs(state: DataFrame, weight: Column) -> DataFrame:
    """(p, n): one row per adjacent symbol pair, p = left SEP right."""
    return state.select(weight.alias("n"),
                        F.explode(F.regexp_extract_all("syms", F.lit(PAIR_PATTERN), 1)).alias("p"))


def _split_pair(df: DataFrame) -> DataFrame:
    return df.select(F.substring_index("p", SEP, 1).alias("left"),
                     F.substring_index("p", SEP, -1).alias("right"), "count")


def _pair_key_counts(state: DataFrame) -> DataFrame:
    return _pairs(state, F.col("n")).groupBy("p").agg(F.sum("n").alias("count"))


def pair_counts(state: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word count: (left, right, count)."""
    return _split_pair(_pair_key_counts(state)).select(
        unescaped(F.col("left")).alias("left"), unescaped(F.col("right")).alias("right"), "count")


def alphabet(words: DataFrame) -> DataFrame:
    return words.select(F.explode(F.regexp_extract_all("word", F.lit(CHAR_PATTERN), 0))
                        .alias("ch")).distinct()


def _regex_literal(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def _replacement_literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def apply_merge(syms: Column, left: str, right: str) -> Column:
    """Merge every left-to-right, non-overlapping occurrence of (left, right)."""
    pat = f"(^|{SEP}){_regex_literal(left)}{SEP}{_regex_literal(right)}(?={SEP}|$)"
    return F.regexp_replace(syms, F.lit(pat), F.lit("$1" + _replacement_literal(left + right)))


def _merged(word: list[str], a: str, b: str) -> list[str]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and word[i] == a and word[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


class _Band:
    """Sequential BPE over the pieces of words that hold pairs of ``least`` or more, the band.

    Words are cut at pairs outside the band. A token of a merge has a first and a last
    symbol among those that the words held at the start; a pair of tokens stands where
    the last symbol of the one met the first of the other, and counts no more than these
    two did. So a pair of at least ``least`` has all its places inside the pieces.

    The exception is a token that is made in two ways, from other outer symbols: a pair
    with it may stand inside pieces here and at a cut there. ``outside`` (counts of pairs
    outside the band, any other: ``floor``) bounds what the cuts hide; the heap ranks such
    a pair by its largest possible count, and the band ends where one comes first.
    """

    def __init__(self, rows, least: int, whole: bool = False, band=frozenset(), outside=None, floor: int = 0):
        self.least, self.whole, self.band, self.floor = least, whole, band, floor
        self.outside = outside or {}
        self.words = [r["syms"].split(SEP) for r in rows]
        self.n = [int(r["n"]) for r in rows]
        self.count: Counter = Counter()
        self.places: dict[tuple[str, str], set[int]] = {}
        for k, w in enumerate(self.words):
            for p in zip(w, w[1:]):
                self.count[p] += self.n[k]
                self.places.setdefault(p, set()).add(k)
        self.heap = [(-c, *p) for p, c in self.count.items() if c >= least]
        heapq.heapify(self.heap)
        self.first: dict[str, set[str]] = {}  # outer symbols of the tokens made here
        self.last: dict[str, set[str]] = {}
        self.unclear: set[str] = set()        # tokens with more than one first or last symbol
        self.most_after: Counter = Counter()  # largest count outside the band by left and by right symbol
        self.most_before: Counter = Counter()
        for (a, b), c in self.outside.items():
            self.most_after[a] = max(self.most_after[a], c)
            self.most_before[b] = max(self.most_before[b], c)

    def _hidden(self, x: str, y: str) -> int:
        """A bound on the places of (x, y) at cuts; 0 if all or none of its places are inside."""
        if x not in self.unclear and y not in self.unclear:
            return 0
        return sum(self.outside.get((u, v), self.floor) for u in self.last.get(x, {x}) for v in self.first.get(y, {y})
                   if (u, v) not in self.band)

    def _bound(self, p: tuple[str, str]) -> int:
        return self.count[p] + self._hidden(*p)

    def _made(self, a: str, b: str, known: set[str]) -> int:
        """Note the token of a merge; returns a bound on the pairs with it that stand at cuts only."""
        t = a + b
        own = {t} if t in known and t not in self.first else set()
        old = (self.first.get(t, own), self.last.get(t, own))
        self.first[t] = old[0] | self.first.get(a, {a})
        self.last[t] = old[1] | self.last.get(b, {b})
        known.add(t)
        if self.whole or (len(self.first[t]) == 1 and len(self.last[t]) == 1):
            return 0
        self.unclear.add(t)
        for p, c in self.count.items():  # pairs with it rank by their bounds from now on
            if c > 0 and t in p and self._bound(p) >= self.least:
                heapq.heappush(self.heap, (-self._bound(p), *p))
        ways = max(len(x) for e in (self.first, self.last) for x in e.values())  # of the other token
        return ways * max(sum(max(self.most_before[v], self.floor) for v in self.first[t]),
                          sum(max(self.most_after[u], self.floor) for u in self.last[t]))

    def take(self, most: int, known: set[str]) -> list[tuple[str, str, int]]:
        """Up to ``most`` merges."""
        taken: list[tuple[str, str, int]] = []
        risk = 0
        while self.heap and len(taken) < most:
            c, a, b = heapq.heappop(self.heap)
            now = self._bound((a, b))
            if now < self.least:
                continue
            if now != -c:  # an old entry: it comes again with its present count
                heapq.heappush(self.heap, (-now, a, b))
                continue
            if now <= risk or self._hidden(a, b):
                break
            taken.append((a, b, now))
            fresh: set[tuple[str, str]] = set()
            for k in sorted(self.places.get((a, b), ())):
                old = self.words[k]
                new = _merged(old, a, b)
                if len(new) == len(old):
                    continue
                for p in zip(old, old[1:]):
                    self.count[p] -= self.n[k]
                for p in zip(new, new[1:]):
                    self.count[p] += self.n[k]
                    self.places.setdefault(p, set()).add(k)
                    if a + b in p:
                        fresh.add(p)
                self.words[k] = new
            risk = max(risk, self._made(a, b, known))
            for p in fresh:
                if self._bound(p) >= self.least:
                    heapq.heappush(self.heap, (-self._bound(p), *p))
        return taken


def _ranked(state: DataFrame, min_count: int) -> list:
    """The top of the pair ranking: p, count."""
    return (_pair_key_counts(state).select(
        "p", "count", F.substring_index("p", SEP, 1).alias("left"), F.substring_index("p", SEP, -1).alias("right"))
        .where(F.col("count") >= min_count)
        .orderBy(F.col("count").desc(), F.col("left").asc(), F.col("right").asc()).limit(RANKED).collect())


def _pieces(spark: SparkSession, state: DataFrame, band: set[tuple[str, str]]) -> DataFrame:
    """(syms, n): the words cut at pairs outside the band, equal pieces of two symbols or more added up."""
    sent = spark.sparkContext.broadcast(band)  # at most RANKED pairs

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        inside = sent.value
        for words in batches:
            out = []
            for word in words:
                syms = word.split(SEP)
                found, start = [], 0
                for i in range(1, len(syms) + 1):
                    if i == len(syms) or (syms[i - 1], syms[i]) not in inside:
                        if i - start > 1:
                            found.append(SEP.join(syms[start:i]))
                        start = i
                out.append(found)
            yield pd.Series(out, dtype=object)
    return (state.select(cut("syms").alias("e"), "n").select(F.explode("e").alias("syms"), "n")
            .groupBy("syms").agg(F.sum("n").alias("n")))


def _replayed(syms: list[str], steps: dict[tuple[str, str], list[int]]) -> list[str]:
    """The merges of a round on one word, in their order (``steps``: the places of each pair in it)."""
    at = 0
    while len(syms) > 1:
        best = None
        for p in zip(syms, syms[1:]):
            for step in steps.get(p, ()):
                if step >= at and (best is None or step < best[0]):
                    best = (step, p)
        if best is None:
            break
        syms, at = _merged(syms, *best[1]), best[0] + 1
    return syms


def _rewritten(spark: SparkSession, state: DataFrame, taken: list[tuple[str, str, int]]) -> DataFrame:
    """The words after a round's merges; words of one symbol can never merge again and go."""
    steps: dict[tuple[str, str], list[int]] = {}
    for i, (a, b, _) in enumerate(taken):
        steps.setdefault((a, b), []).append(i)
    sent = spark.sparkContext.broadcast(steps)

    @F.pandas_udf(T.StringType())
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield pd.Series([SEP.join(_replayed(w.split(SEP), sent.value)) for w in words], dtype=object)
    return state.select("n", rewrite("syms").alias("syms")).where(F.instr("syms", SEP) > 0)


def learn_merges(spark: SparkSession, words: DataFrame, n_merges: int,
                 min_count: int = 1, checkpoint_every: int = 8,
                 candidates: int = 64, band_words: int = BAND_WORDS) -> list[tuple[str, str, int]]:
    """T5: learn up to ``n_merges`` merges from (word, n). Returns the merges in
    rank order as (left, right, count); only this bounded list is kept on the driver.

    Exact sequential BPE (count desc, then left, right ascending). The best pairs
    of a round, the band, are as many as make at most ``band_words`` different pieces
    of words (``candidates`` in the first round, then by what the last one made); at
    least one pair. At most ``band_words`` pieces and ``RANKED`` pairs reach the
    driver at a time, whatever the corpus.

    The words are persisted every round and checkpointed every ``checkpoint_every``
    rounds (reliable files under spark.checkpoint.dir).
    """
    state = initial_symbols(words.select("word", "n")).where(F.length("word") > 1).select("n", "syms").checkpoint(eager=True)
    merges: list[tuple[str, str, int]] = []
    known: set[str] = set()
    whole = state.count() <= band_words  # so few words are one band
    if whole:
        state = state.where(F.instr("syms", SEP) > 0)
        return [(_plain(a), _plain(b), c) for a, b, c in _Band(state.collect(), max(min_count, 1), True).take(n_merges, known)]
    held: list[DataFrame] = []  # persisted word states since the last checkpoint
    width, r = max(candidates, 1), 0
    while len(merges) < n_merges:
        ranked = _ranked(state, min_count)
        # counting read the previous words in full, so older copies are no longer needed
        while len(held) > 1:
            held.pop(0).unpersist()
        if not ranked:
            break
        floor = 0 if len(ranked) < RANKED else int(ranked[-1]["count"])
        if len(ranked) < RANKED and min_count > 1:
            floor = min_count - 1
        while True:
            least, most = max(int(ranked[min(width, len(ranked)) - 1]["count"]), 1), n_merges - len(merges)
            if len(ranked) == RANKED and least == floor:  # pairs of this count may be missing in the list
                least = floor + 1
            if least > int(ranked[0]["count"]):  # more equal pairs than the list holds: the first one alone
                least, most = least - 1, 1
                inside = ranked[:1]
            else:
                inside = [x for x in ranked if int(x["count"]) >= least]
            band = {(x["left"], x["right"]) for x in inside}
            pieces = _pieces(spark, state, band)
            alone = len(inside) == 1 or int(inside[-1]["count"]) == int(ranked[0]["count"])
            rows = (pieces if alone else pieces.limit(band_words + 1)).collect()
            if alone or len(rows) <= band_words:
                break
            width = max(1, min(width, len(inside)) // 4)
        outside = {(x["left"], x["right"]): int(x["count"]) for x in ranked if (x["left"], x["right"]) not in band}
        taken = _Band(rows, least, False, band, outside, floor).take(most, known)
        merges += taken
        if len(rows) * 8 <= band_words:
            width = max(width, min(4 * width, RANKED))
        elif len(rows) * 3 <= band_words:
            width = max(width, min(2 * width, RANKED))
        state = _rewritten(spark, state, taken)
        r += 1
        if r % checkpoint_every == 0:
            state = state.checkpoint(eager=True)
            for h in held:
                h.unpersist()
            held = []
        else:
            state = state.persist()
            held.append(state)
    for h in held:
        h.unpersist()
    return [(_plain(a), _plain(b), c) for a, b, c in merges[:n_merges]]


def merges_frame(spark: SparkSession, merges: Sequence[tuple[str, str, int]]) -> DataFrame:
    rows = [(i + 1, a, b, a + b, int(c)) for i, (a, b, c) in enumerate(merges)]
    schema = "rank INT, left STRING, right STRING, token STRING, count BIGINT"
    return spark.createDataFrame(rows, schema)


def vocabulary(alpha: Sequence[str], merges: Sequence[tuple[str, str, int]],
               specials: Sequence[str] = SPECIAL_TOKENS) -> dict[str, int]:
    """Token -> id: special tokens, then the alphabet by code point, then merges
    in creation order (a merged token already present keeps its first id)."""
    vocab: dict[str, int] = {}
    for t in list(specials) + sorted(alpha) + [a + b for a, b, _ in merges]:
        if t not in vocab:
            vocab[t] = len(vocab)
    return vocab


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------

def pretokens(text: Column) -> Column:
    """The words that learning counts: the encoder gets the same array."""
    return tokens(text, WORD_PATTERN)


def bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Rank-ordered merging of one word (lowest-rank pair first, left-most)."""
    syms = list(word)
    while len(syms) > 1:
        best, at = None, -1
        for i in range(len(syms) - 1):
            r = ranks.get((syms[i], syms[i + 1]))
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        a, b = syms[at], syms[at + 1]
        out, i = [], 0
        while i < len(syms):
            if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def encoder(spark: SparkSession, alpha: Sequence[str], merges: Sequence[tuple[str, str, int]]):
    """A pandas UDF array of words (``pretokens``) -> ARRAY<INT> of ids ([UNK] for unknown symbols)."""
    vocab = vocabulary(alpha, merges)
    if len(vocab) > MAX_VOCAB:
        raise ValueError(f"vocabulary of {len(vocab)} tokens is too large to broadcast")
    ranks = {(a, b): i for i, (a, b, _) in enumerate(merges)}
    bc = spark.sparkContext.broadcast((vocab, ranks))
    unk = vocab[SPECIAL_TOKENS[0]]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc, rk = bc.value
        cache: dict[str, list[int]] = {}
        for words in batches:
            out = []
            for own in words:
                if own is None:
                    out.append(None)
                    continue
                ids: list[int] = []
                for w in own:
                    e = cache.get(w)
                    if e is None:
                        e = [voc.get(s, unk) for s in bpe_word(w, rk)]
                        if len(cache) < CACHED_WORDS:
                            cache[w] = e
                    ids.extend(e)
                out.append(ids)
            yield pd.Series(out, dtype=object)

    return encode


def tail_ids(ids: Column, n: int) -> Column:
    """The last ``n`` ids (the own model keeps the end of long texts)."""
    return F.slice(ids, F.greatest(F.size(ids) - F.lit(n - 1), F.lit(1)), n)


def head_ids(ids: Column, n: int) -> Column:
    """The first ``n`` ids (truncation of the pretrained model's tokenizer)."""
    return F.slice(ids, 1, n)


def pad_id() -> int:
    return SPECIAL_TOKENS.index("[PAD]")
