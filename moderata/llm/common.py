"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table  # noqa: F401  (re-exported for the operators)

WHITE = b" \t\n\x0b\x0c\r"
PIECE = 1 << 18   # bytes of one text handled at a time
SLAB = 1 << 19    # bytes of several texts handled in one numpy pass
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: losing an executor later costs a re-read, not a re-run,
    and the planner sees the measured size of the table. The job's shuffle files
    go when the table is complete.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> str:
    """Python workers get ``rows`` rows at a time at most, from now on in this session; returns the setting before.

    A document can be long: Spark's 10,000 of them are tens of MB in each worker, several times over.
    """
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH, rows)
    return before


def id_bucket(col, n: int):
    """crc32 of the id's decimal text modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(raw: bytes, size: int = PIECE):
    """Pieces of a text, cut after white space only; the cuts depend on the text alone."""
    at, n = 0, len(raw)
    while n - at > size:
        end = max(raw.rfind(bytes([c]), at, at + size) for c in WHITE)
        if end < at:
            later = [p for p in (raw.find(bytes([c]), at + size) for c in WHITE) if p >= 0]
            if not later:
                break
            end = min(later)
        yield raw[at:end + 1]
        at = end + 1
    yield raw[at:]


def slabs(texts, size: int = SLAB):
    """Group the pieces of many texts into slabs: lists of (text number, piece)."""
    held, total = [], 0
    for k, text in enumerate(texts):
        if text is None:
            continue
        for piece in cut(text.encode("utf-8", "surrogatepass")):
            held.append((k, piece))
            total += len(piece)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def joined(slab):
    """One byte array of a slab (pieces parted by a space) and each piece's start."""
    raw = b" ".join(p for _, p in slab)
    starts = np.cumsum([0] + [len(p) + 1 for _, p in slab[:-1]])
    return np.frombuffer(raw, dtype=np.uint8), starts, np.array([k for k, _ in slab])


def word_spans(buf: np.ndarray, is_word: np.ndarray):
    """Starts and ends of maximal runs of word bytes."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = is_word[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_table(not_word: bytes) -> np.ndarray:
    out = np.ones(256, dtype=np.int8)
    out[list(not_word)] = 0
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good diffusion (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE_CODES.copy()
_FOLDED[65:91] = _BYTE_CODES[97:123]
_RADIX = np.uint64(0x5851F42D4C957F2D)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True):
    """A 64-bit hash of each word; ``fold`` ignores the case of A-Z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(int(sizes.sum()))
    inner = at - np.repeat(first, sizes)
    powers = np.multiply.accumulate(np.concatenate(
        (np.ones(1, np.uint64), np.full(int(sizes.max()) - 1, _RADIX, np.uint64))))
    codes = (_FOLDED if fold else _BYTE_CODES)[buf[inner + np.repeat(starts, sizes)]]
    sums = np.add.reduceat(codes * powers[inner], first)
    return mix64(sums + sizes.astype(np.uint64))


def hashed_words(texts, is_word: np.ndarray):
    """Yield (text number, word hashes) per text, in order; texts without a word are left out."""
    current, parts = None, []
    for slab in slabs(texts):
        buf, offsets, owner = joined(slab)
        starts, ends = word_spans(buf, is_word)
        codes = word_hashes(buf, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        for k, lo, hi in zip(owner, cuts, np.append(cuts[1:], len(starts))):
            if k != current:
                if parts:
                    yield current, np.concatenate(parts)
                current, parts = k, []
            if hi > lo:
                parts.append(codes[lo:hi])
    if parts:
        yield current, np.concatenate(parts)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
