"""Language identification by prediction by partial matching (operator 5).

Every language has a context tree over bytes: counts of the byte that follows
each context of up to three bytes. A byte is coded in its longest known context;
if it was never seen there, an escape (probability distinct / (total + distinct),
escape method C) leads to the next shorter context, down to uniform
probability over 256 bytes. Counts are frozen after learning. A text's language
is the one whose tree codes the whole text in the fewest bits.

ASCII letters are folded and digits merged; bytes unknown to all trees are one
symbol. All code lengths are computed once per (context, byte), so scoring is
one table look-up per byte for all languages at once. Contexts of three bytes
seen fewer than ``MIN_SEEN`` times in the sample are left to the two-byte ones;
of the others each language brings its own ``max_contexts`` most frequent ones
(ties: the smaller code), whatever the other languages hold, and all languages
are coded in all contexts brought. The tables take at most
(symbols^2 + languages x max_contexts) x symbols x languages x 4 bytes.

Learning reads a bounded sample: per language the ``MAX_DOCS`` documents with
the smallest hash of the id outside the held-out fold (crc32 mod 4 = 2). Texts
of more than ``MAX_CHARS`` characters teach too: by as many passages of
``PASSAGE`` characters as fit in that bound, taken from anywhere in the text by
a hash of the id and the passage's number. Scoring reads every byte of every text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
null languages teach nothing; ties go to the first language by name; the score
is the share of the best language in the sum of 2^-bits; without any learned
language every text is ``und``; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bucket, joined, slabs, written

MAX_DOCS = 300
MAX_CHARS = 20_000
PASSAGE = 1_000
MIN_SEEN = 12
MAX_CONTEXTS = 12_000   # per language


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = np.arange(97, 123)
    out[48:58] = 48
    out[[9, 11, 12, 13]] = 32
    return out


_FOLD = _fold()


def _bounded() -> Column:
    """A text of at most ``MAX_CHARS`` characters, or so much of a longer one in hashed passages, in their order."""
    numbers = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PASSAGE).cast("int"))
    ranked = F.sort_array(F.transform(numbers, lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i"))))
    chosen = F.sort_array(F.transform(F.slice(ranked, 1, MAX_CHARS // PASSAGE), lambda x: x["i"]))
    passages = F.transform(chosen, lambda i: F.substring(F.col("text"), i * PASSAGE + 1, F.lit(PASSAGE)))
    return F.when(F.char_length("text") <= MAX_CHARS, F.col("text")).otherwise(F.array_join(passages, " "))


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> list[tuple[str, str]]:
    """(language, text) of the learning sample; at most max_docs per language."""
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                     & (id_bucket(F.col("doc_id"), 4) != 2))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "k")
    # ranked on narrow rows; Spark keeps max_docs rows per language and task before the shuffle
    # written first, so that the join knows its size: at most max_docs narrow rows a language
    best = written(own.select("lang", "doc_id", F.xxhash64("text").alias("k"))
                   .withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_docs)
                   .select("lang", "doc_id", "k").distinct(), "sample")
    rows = (own.select("lang", "doc_id", "text", F.xxhash64("text").alias("k"))
            .join(best, ["lang", "doc_id", "k"], "left_semi").select("lang", "doc_id", _bounded().alias("text")).distinct().collect())
    return sorted((r["lang"], r["text"]) for r in rows)


def learn(rows: list[tuple[str, str]], max_contexts: int = MAX_CONTEXTS) -> dict | None:
    """Frozen code lengths: table[context row, byte, language] in bits."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    texts = {lang: [np.concatenate((np.full(3, 32, np.uint8), _FOLD[np.frombuffer(t.encode(), np.uint8)]))
                    for other, t in rows if other == lang] for lang in langs}
    known = sorted(set(np.unique(np.concatenate([t for ts in texts.values() for t in ts])).tolist()) | {32})
    size = len(known) + 1  # the last symbol: a byte unknown to all
    symbol = np.full(256, size - 1, dtype=np.uint8)
    symbol[known] = np.arange(size - 1)
    symbol = symbol[_FOLD]
    grams = {}
    for lang in langs:
        got = [np.zeros(size ** k, dtype=np.int64) for k in (1, 2, 3)]
        quads = []
        for t in texts[lang]:
            s = symbol[t].astype(np.int64)
            b1, b2, b3 = s[3:], s[2:-1] * size + s[3:], (s[1:-2] * size + s[2:-1]) * size + s[3:]
            for counts, codes in zip(got, (b1, b2, b3)):
                counts += np.bincount(codes, minlength=len(counts))
            quads.append(s[:-3] * size ** 3 + b3)
        grams[lang] = (*got, np.concatenate(quads))
    own = [np.unique(grams[lang][3] // size, return_counts=True) for lang in langs]
    codes, group = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
    seen = np.bincount(group, weights=np.concatenate([n for _, n in own]), minlength=len(codes))
    frequent = codes[seen >= MIN_SEEN]
    deep = np.zeros(0, dtype=np.int64)
    for c, n in own:
        held = np.isin(c, frequent)
        c, n = c[held], n[held]
        deep = np.union1d(deep, c[np.argsort(-n, kind="stable")[:max_contexts]])
    row = np.tile(np.arange(size * size, dtype=np.int32), size)  # context (b1 b2 b3) -> row of (b2 b3)
    row[deep] = size * size + np.arange(len(deep), dtype=np.int32)
    table = np.zeros((size * size + len(deep), size, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        c1, c2, c3, quads = grams[lang]
        p = _blend(c1[None, :], np.full((1, size), 1 / 256))
        p = _blend(c2.reshape(size, size), np.broadcast_to(p, (size, size)))
        p = _blend(c3.reshape(size * size, size), np.tile(p, (size, 1)))
        table[:size * size, :, k] = -np.log2(p)
        at = np.searchsorted(deep, quads // size)
        at[at == len(deep)] = 0
        hit = deep[at] == quads // size if len(deep) else np.zeros(len(quads), dtype=bool)
        c4 = np.bincount(at[hit] * size + quads[hit] % size, minlength=len(deep) * size).reshape(len(deep), size)
        table[size * size:, :, k] = -np.log2(_blend(c4, p[deep % (size * size)]))
    return {"langs": langs, "symbol": symbol, "size": size, "row": row, "table": table}


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts; ``shorter``: those in the next shorter contexts."""
    total = counts.sum(1, keepdims=True)
    distinct = (counts > 0).sum(1, keepdims=True)
    known = total > 0
    below = np.where(known, total + distinct, 1)
    return np.where(counts > 0, counts / below, np.where(known, distinct / below, 1.0) * shorter)


def bits(model: dict, texts) -> np.ndarray:
    """Code length of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(model["langs"])))
    size = model["size"]
    space = model["symbol"][32]
    for slab in slabs(texts):
        buf, offsets, owner = joined(slab)
        s = model["symbol"][buf].astype(np.int32)
        old = np.concatenate((np.full(3, space, np.int32), s))
        context = (old[:-3] * size + old[1:-2]) * size + old[2:-1]
        for k in range(min(3, len(s))):  # a piece starts after spaces
            at = offsets[offsets + k < len(s)] + k
            near = [old[at + j] if j + k >= 3 else np.full(len(at), space, np.int32) for j in range(3)]
            context[at] = (near[0] * size + near[1]) * size + near[2]
        cost = model["table"][model["row"][context], s]
        ends = np.append(offsets[1:] - 1, len(s))
        cost[ends[:-1]] = 0  # the spaces that part the pieces
        full = np.flatnonzero(ends > offsets)
        if len(full):
            sums = np.add.reduceat(cost.astype(np.float64), offsets[full], axis=0)
            np.add.at(out, owner[full], sums)
    return out


def predictor(model: dict | None):
    """A column function (text, has a letter) -> (lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, letter in it:
            name = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            use = np.flatnonzero(letter.to_numpy(dtype=bool))
            if model is not None and len(use):
                cost = bits(model, list(texts.iloc[use]))
                best = cost.argmin(1)
                name[use] = np.array(model["langs"], dtype=object)[best]
                gap = np.minimum(cost - cost.min(1, keepdims=True), 1000)
                score[use] = 1 / (2.0 ** -gap).sum(1)
            yield pd.DataFrame({"lang_pred": name, "score": score})
    return predict


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (docs.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
                        predictor(model)(F.col("text"), letter).alias("x"))
            .select("doc_id", "held_out", "x.lang_pred", "x.score"))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict | None:
    return learn(sample(docs, max_docs))


def brute_force_bits(rows: list[tuple[str, str]], text: str, lang: str, max_contexts: int = MAX_CONTEXTS) -> float:
    """Plain recursive code length for tests: every byte after three spaces."""
    from collections import Counter
    from math import log2

    def symbols(t):
        return [int(x) for x in _FOLD[np.frombuffer(t.encode(), np.uint8)]]
    known = {s for _, t in rows for s in symbols(t)} | {32}
    seen = {name: Counter() for name, _ in rows}
    for name, t in rows:
        s = [32] * 3 + symbols(t)
        seen[name].update(tuple(s[k - 3:k]) for k in range(3, len(s)))
    every = sum(seen.values(), Counter())
    deep = set()
    for counts in seen.values():
        held = sorted((-n, c) for c, n in counts.items() if every[c] >= MIN_SEEN)
        deep |= {c for _, c in held[:max_contexts]}
    trees = [Counter() for _ in range(4)]
    for own, t in rows:
        if own == lang:
            s = [32] * 3 + symbols(t)
            for k in range(3, len(s)):
                for n in range(4):
                    trees[n][tuple(s[k - n:k]), s[k]] += 1

    def probability(context, x):
        own = {b: c for (ctx, b), c in trees[len(context)].items() if ctx == context}
        if len(context) == 3 and context not in deep:
            own = {}
        below = probability(context[1:], x) if context else 1 / 256
        if not own:
            return below
        total, distinct = sum(own.values()), len(own)
        return own[x] / (total + distinct) if x in own else distinct / (total + distinct) * below
    s = [32] * 3 + [x if x in known else -1 for x in symbols(text)]
    return sum(-log2(probability(tuple(s[k - 3:k]), s[k])) for k in range(3, len(s)))
