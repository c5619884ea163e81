"""Periodic runs of words by string synchronising sets (operator 12).

A run is a stretch of consecutive words with smallest period q, at least
max(6, 4 q) words long, that no neighbouring word extends. All runs of every
text are found exactly:

* Windows of 1, 2, 4, 8, ... words get integer names by doubling (equal names if
  and only if the words are equal), so no hash can mislead.
* At scale tau the synchronising set holds the positions i for which the
  smallest hashed name among the windows at i .. i + tau is that of the first or
  of the last one. Windows with a period of at most tau / 3 are left out.
  Whether i is chosen depends on the words i .. i + 2 tau - 1 alone, and every
  stretch of 3 tau - 1 words without a period of tau / 3 or less starts with a
  chosen position among its first tau. A run of period q is such a stretch
  at the scale tau <= q < 2 tau (Fine and Wilf), so it holds chosen positions s
  and s + q with equal contexts of 2 tau words: neighbouring chosen positions
  with equal contexts propose their distance as a period.
* The highly periodic windows left out are detected on their own: the next
  equal half window lies exactly one period further. They propose the small
  periods (all below ``FIRST_SCALE`` come from there).
* Every proposal is extended both ways by the names of descending scales and
  kept if the stretch is long enough and has no smaller period.

Scale. A text is one row's work; texts are handled in slabs of ``SLAB_WORDS``
words, and only texts with a repeated window of four words (every run has one)
go beyond the second doubling. No shuffle; memory grows with the longest text.

Defined cases: null, empty and blank texts have no words and no runs (nulls, and
digests of nothing); a null id counts as empty text in the hash that decides
which texts are made periodic; repeated rows are answered one by one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64

SLAB_WORDS = 200_000
FIRST_SCALE = 4
MIN_WORDS, MIN_PERIODS = 6, 4
_LEFT_OUT = np.iinfo(np.uint64).max


def doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of windows of 2 * step words from those of step words; a window seen once has a name of its own."""
    n = len(names) - step
    if n <= 0:
        return names[:0]
    counts = np.bincount(names)
    often = counts[names] > 1
    at = np.flatnonzero(often[:n] & often[step:])
    out = np.arange(len(at), len(at) + n)  # beyond the names of the windows in question
    if len(at):
        pair = names[at] * np.int64(len(counts)) + names[at + step]
        out[at] = np.unique(pair, return_inverse=True)[1]
    return out


def following(names: np.ndarray) -> np.ndarray:
    """Position of the next window with the same name (the length if there is none)."""
    order = np.argsort(names, kind="stable")
    out = np.full(len(names), len(names))
    same = names[order[1:]] == names[order[:-1]]
    out[order[:-1][same]] = order[1:][same]
    return out


def periodic_windows(half: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows of ``size`` words with a period of at most size / 2, and these periods.

    ``half`` names the windows of size / 2 words.
    """
    h = size // 2
    n = len(half) - h
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    period = following(half)[:n] - np.arange(n)
    at = np.flatnonzero(period <= h)
    at = at[half[at + h - period[at]] == half[at + h]]
    return at, period[at]


def synchronising(names: np.ndarray, left_out: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set at ``scale``; ``names`` are those of its windows."""
    n = len(names) - scale
    if n <= 0:
        return np.zeros(0, np.int64)
    rank = mix64(names.astype(np.uint64) + np.uint64(1))
    rank[left_out] = _LEFT_OUT
    low, width = rank, 1
    while width < scale:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], rank[scale:])
    return np.flatnonzero((low != _LEFT_OUT) & ((rank[:n] == low) | (rank[scale:] == low)))


def extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretches around ``at`` that keep their period."""
    right, left = at + period, at.copy()
    for k in reversed(range(len(levels))):
        names, size = levels[k], 1 << k
        fits = right < len(names)
        fits[fits] = names[right[fits]] == names[right[fits] - period[fits]]
        right = right + fits * size
        fits = (left >= size) & (left - size + period < len(names))
        fits[fits] = names[left[fits] - size] == names[left[fits] - size + period[fits]]
        left = left - fits * size
    return left, right


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of non-negative integers, by start and period."""
    found, levels = [], [words]
    scale = 1  # levels[-1] names the windows of ``scale`` words
    while len(levels[-1]) and np.bincount(levels[-1]).max() > 1:
        levels.append(doubled(levels[-1], scale))
        scale *= 2
        at, period = periodic_windows(levels[-2], scale)
        left_out = at[3 * period <= scale]
        if scale > 2 * FIRST_SCALE:  # smaller scales take every period up to half the window
            at, period = left_out, period[3 * period <= scale]
        if len(at):  # one proposal for neighbouring windows of the same period
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
            found.append((at[fresh], period[fresh]))
        if scale >= FIRST_SCALE:
            chosen = synchronising(levels[-1], left_out, scale)
            context = doubled(levels[-1], scale)[chosen]
            order = np.argsort(context, kind="stable")
            same = context[order[1:]] == context[order[:-1]]
            here, there = chosen[order[:-1][same]], chosen[order[1:][same]]
            apart = there - here
            fits = (apart >= scale) & (apart < 2 * scale)
            found.append((here[fits], apart[fits]))
    if not found:
        return np.zeros((0, 3), np.int64)
    at, period = (np.concatenate(c) for c in zip(*found))
    start, end = extended(levels, at, period)
    rows = np.unique(np.stack([start, end - start, period], axis=1), axis=0)
    rows = rows[rows[:, 1] >= np.maximum(MIN_WORDS, MIN_PERIODS * rows[:, 2])]
    if len(rows):  # the same stretch with a smaller period comes first
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of several texts at once: each is a sequence of integers from 0, numbered on its own."""
    sizes = np.array([len(t) for t in texts])
    out = [np.zeros((0, 3), np.int64)] * len(texts)

    def together(which):
        """The texts ``which`` in one sequence, without a common value, each followed by a value of its own."""
        lengths = sizes[which] + 1
        room = np.array([int(texts[w].max()) + 2 if sizes[w] else 1 for w in which])
        base = np.cumsum(room) - room
        joined = np.concatenate([np.append(texts[w], r - 1) for w, r in zip(which, room)]) + np.repeat(base, lengths)
        return joined, np.cumsum(lengths) - lengths, np.repeat(np.arange(len(which)), lengths)
    which = np.flatnonzero(sizes >= MIN_WORDS)
    if not len(which):
        return out
    joined, _, owner = together(which)
    four = doubled(doubled(joined, 1), 2)
    often = np.bincount(four)[four] > 1 if len(four) else np.zeros(0, bool)
    which = which[np.unique(owner[:len(four)][often])]
    if not len(which):
        return out
    joined, starts, _ = together(which)
    rows = runs(joined)
    cuts = np.searchsorted(rows[:, 0], np.append(starts, len(joined)))
    for w, start, lo, hi in zip(which, starts, cuts[:-1], cuts[1:]):
        own = rows[lo:hi].copy()
        own[:, 0] -= start
        out[w] = own
    return out


def made_periodic(n: int, doc_id) -> np.ndarray | None:
    """Word numbers that a text of n words is read by, if its id's hash makes it periodic."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


_LONGS = T.LongType()
RESULT = T.StructType(
    [T.StructField(c, _LONGS) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    + [T.StructField(c, _LONGS) for c in ("n_words", "n_dropped")]
    + [T.StructField("runs", T.ArrayType(T.ArrayType(_LONGS)))])


def _told(words: list[bytes], found: np.ndarray) -> tuple:
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period:start + length] = False
    left = words if kept.all() else [words[k] for k in np.flatnonzero(kept)]
    best = (None,) * 4
    if len(found):
        s, n, q = min(found.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(left)).hexdigest(), len(words), len(words) - len(left), found.tolist())


@F.pandas_udf(RESULT)
def detected(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Runs of each text, made periodic where its id's hash says so."""

    def answered(held):
        found = runs_of_texts([numbers for _, numbers in held])
        return [_told(words, f) for (words, _), f in zip(held, found)]
    for ids, texts in batches:
        rows, held, total = [], [], 0
        for doc_id, text in zip(ids, texts):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            numbers = _numbered(words)
            at = made_periodic(len(words), doc_id)
            if at is not None:
                numbers = numbers[at]
                words = [words[k] for k in at]
            held.append((words, numbers))
            total += len(words)
            if total >= SLAB_WORDS:
                rows += answered(held)
                held, total = [], 0
        rows += answered(held)
        told = pd.DataFrame(rows, columns=RESULT.names)
        for c in ("start", "length", "period", "exponent_milli"):
            told[c] = told[c].astype("Int64")
        yield told


def runs_per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the columns of the contract, then n_words, n_dropped and the runs themselves."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .select("doc_id", detected(F.col("doc_id").cast("string"), "text").alias("x")).select("doc_id", "x.*"))


def brute_force(words: list) -> list[tuple[int, int, int]]:
    """Plain version for tests: every period, every start."""
    n, out = len(words), []
    for q in range(1, n // MIN_PERIODS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            if length >= max(MIN_WORDS, MIN_PERIODS * q) and not any(
                    part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))
