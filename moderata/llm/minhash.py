"""Near-duplicate documents by circulant MinHash (operator 8).

Shingles are the distinct runs of ``words`` words of the whole lower-cased text
(four for op8_minhash, five for the pipeline stage). A fixed permutation
``sigma`` scatters a shingle over the circle of 2^64 places; a second
permutation ``pi`` ranks the places. Coordinate k of the signature is the
smallest rank after turning the circle by k steps, so two permutations give all
coordinates (C-MinHash). ``ROWS`` consecutive coordinates form a band;
documents that agree on a band are candidates. With 40 bands of 5 a pair at
similarity 0.8 is missed with probability (1 - 0.8^5)^40 < 2e-7.

Every link is confirmed on the full sets: 100 * |A & B| >= 80 * |A | B|.

Scale. Documents with equal sets are collapsed first. Each document carries a
card of 256 counts (its shingles by slot); the sum of the slot-wise minima of
two cards bounds their overlap from above, so most false candidates fall
without a look at their sets. Buckets of up to ``SMALL`` classes give their few
pairs. Larger buckets are never expanded into all pairs: every member is
compared with the bucket's centre (the member that shares most buckets), and
confirmed links merge components. Only members outside the centre's component
are then compared with the others, each pair in the first band that it shares only,
and only where the shingles that they have in common with any open document
(``r``) and their cards allow a similarity of 0.8, again exact bounds. No link is
lost and no candidate is dropped. A large group of near copies that the centre
links emits about one pair per member; a large bucket of k members outside the
centre's component still compares k times its size, less what the bounds refuse.

Defined cases: a null or empty text, or one without words, has an empty set
(n_shingles 0), is linked with nothing and is kept; fewer than ``words`` words form
one shingle; null ids take no part in links and are kept; rows that repeat an
id are one document (their texts' sets must agree for equal results; the
largest set counts); ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, hashed_words, mix64, word_table, written

WORDS = 4            # op8_minhash, by its contract
PIPELINE_WORDS = 5   # stages on word shingles without a contract
BANDS, ROWS = 40, 5
SMALL = 8
SLOTS = 256
_WORD = word_table(WHITE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words (the whole sequence if shorter)."""
    if len(words) == 0:
        return words
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(min(n, len(words))):
        out = mix64(out + words[k:k + m] + np.uint64(k + 1))
    return np.unique(out)


def signature(sets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: one scattering permutation, one ranking permutation, turned k steps."""
    placed = mix64(sets ^ np.uint64(0x2545F4914F6CDD1D))
    turns = (np.arange(coordinates, dtype=np.uint64) * _STEP)[:, None]
    out = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(placed), 512):
        x = placed[lo:lo + 512][None, :] - turns
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = sig[:bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(31) + grid[:, r])
    return out.view(np.int64)


def _told(*more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")] + [T.StructField(*m) for m in more])


def card(own: np.ndarray) -> bytes:
    """Counts of the shingles by slot, one byte each; empty where a count passes 255."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=SLOTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _small(it, rows: int = 1000):
    """Batches of at most ``rows`` rows, so that results are handed on before the next are made."""
    for texts in it:
        for lo in range(0, len(texts), rows):
            yield texts.iloc[lo:lo + rows]


def _per_text(texts, n_words: int, **fill):
    """Columns n, d1, d2 of each text's set, and more functions of the set for texts with words."""
    n = len(texts)
    size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    more = {c: [None] * n for c in fill}
    for k, words in hashed_words(texts, _WORD):
        own = shingles(words, n_words)
        size[k] = len(own)
        d1[k] = own.sum(dtype=np.uint64).view(np.int64)
        d2[k] = mix64(own).sum(dtype=np.uint64).view(np.int64)
        for c, f in fill.items():
            more[c][k] = f(own)
    return pd.DataFrame({"n": size, "d1": d1, "d2": d2, **{c: pd.Series(v, dtype=object) for c, v in more.items()}})


def sketched(n_words: int):
    """Size, digest, band hashes and card of each text's set."""
    def sketch(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _small(it):
            yield _per_text(texts, n_words, bands=lambda own: bands_of(signature(own, BANDS * ROWS)), card=card)
    return F.pandas_udf(sketch, _told(("bands", T.ArrayType(T.LongType())), ("card", T.BinaryType())))


def full_sets(n_words: int):
    """Size, digest and the sorted set itself."""
    def full(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _small(it):
            yield _per_text(texts, n_words, shingles=lambda own: own.tobytes())
    return F.pandas_udf(full, _told(("shingles", T.BinaryType())))


@F.pandas_udf(T.LongType())
def overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the intersection of two sets of sorted 64-bit values."""
    out = np.zeros(len(left), dtype=np.int64)
    for k, (a, b) in enumerate(zip(left, right)):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[k] = int((y[at] == x).sum())
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def overlap_bound(left: pd.Series, right: pd.Series) -> pd.Series:
    """Upper bound of the overlap by two cards (no bound where a card is empty)."""
    out = np.full(len(left), np.iinfo(np.int64).max // 1000)
    use = np.flatnonzero((left.str.len() > 0).to_numpy() & (right.str.len() > 0).to_numpy())
    for lo in range(0, len(use), 2000):
        at = use[lo:lo + 2000]
        x, y = (np.frombuffer(b"".join(c.iloc[at]), np.uint8).reshape(-1, SLOTS) for c in (left, right))
        out[at] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked(sets: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int64) for x in sets], dtype=object)


FOLDED = 64


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def folded(cards: pd.Series) -> pd.Series:
    """Cards folded to 64 counts, which a join condition can compare (null: no bound)."""
    return pd.Series([np.frombuffer(c, np.uint8).reshape(FOLDED, -1).sum(axis=1).astype(np.int32) if c else None
                      for c in cards], dtype=object)


def possible(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and cards allow a similarity of 0.8."""
    left = cards.select(F.col("id").alias("a"), F.col("card").alias("ca"), F.col("n").alias("na"))
    right = cards.select(F.col("id").alias("b"), F.col("card").alias("cb"), F.col("n").alias("nb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "na", "nb", overlap_bound(F.col("ca"), F.col("cb")).alias("c"))
            .where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * 80).select("a", "b"))


def _pair(a: str = "a", b: str = "b"):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of 0.8 or more."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
    common = overlap(F.col("sa"), F.col("sb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", common.alias("c"))
            .where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * 80).select("a", "b"))


def merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (id, comp) with the components joined that ``links`` (a, b) connect.

    The smallest label spreads over the links between components, with pointer
    jumps; only whether a label changed reaches the driver.
    """
    edges = written(links.join(nodes.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
                    .join(nodes.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
                    .where("ca <> cb").select("ca", "cb").distinct(), "links")
    both = edges.union(edges.select("cb", "ca"))
    root = written(both.groupBy(F.col("ca").alias("v")).agg(F.min("cb").alias("m"))
                   .select("v", F.least("v", "m").alias("r")), "roots")
    while True:
        spread = (both.join(root.select(F.col("v").alias("cb"), "r"), "cb")
                  .groupBy(F.col("ca").alias("v")).agg(F.min("r").alias("m")))
        better = root.join(spread, "v").select("v", F.least("r", "m").alias("r"), F.col("r").alias("old"))
        above = better.select(F.col("v").alias("r"), F.col("r").alias("up"))
        jumped = written(better.join(above, "r").select("v", F.least("r", "up").alias("r"), "old"), "roots")
        root = jumped.select("v", "r")
        if jumped.where("r <> old").isEmpty():
            break
    return written(nodes.join(root.withColumnRenamed("v", "comp"), "comp", "left")
                   .select("id", F.coalesce("r", "comp").alias("comp")), "nodes")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    told = written(rows.select("id", sketched(words)("t").alias("x")).select("id", "x.*"), "sketches")
    known = told.where("id is not null and n > 0")
    own = known.groupBy("id").agg(F.max(F.struct("n", "d1", "d2")).alias("k")).select("id", "k.*")
    # documents with the same set are one class, named by their smallest id
    key = ["n", "d1", "d2"]
    member = written(own.join(own.groupBy(*key).agg(F.min("id").alias("rep")), key)
                     .select("id", "rep", *key), "members")
    reps = member.where("id = rep").select("id", *key)
    # buckets with at least two classes
    placed = (known.join(reps, ["id", *key], "left_semi").select("id", "n", F.posexplode("bands").alias("band", "h"))
              .distinct())
    shared = placed.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(placed.join(shared, ["band", "h"]), "buckets")
    shares = buckets.groupBy("id").agg(F.sum("size").alias("shares"))
    cards = written(known.join(shares, "id").join(reps, ["id", *key], "left_semi")
                    .select("id", "n", "card", "bands", "shares").dropDuplicates(["id"]), "cards")
    small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
    sized = "least(na, nb) * 100 >= greatest(na, nb) * 80"
    few = (small.select("band", "h", F.col("id").alias("a"), F.col("n").alias("na"))
           .join(small.select("band", "h", F.col("id").alias("b"), F.col("n").alias("nb")), ["band", "h"])
           .where("a < b").where(sized).select("a", "b"))
    large = written(large.join(cards.select("id", "shares"), "id"), "large")
    centre = (large.groupBy("band", "h").agg(F.max(F.struct("shares", "id", "n")).alias("c"))
              .select("band", "h", F.col("c.id").alias("b"), F.col("c.n").alias("nb")))
    star = (large.select("band", "h", F.col("id").alias("a"), F.col("n").alias("na")).join(centre, ["band", "h"])
            .where("a <> b").where(sized).select(*_pair()))
    pairs = written(possible(few.union(star).distinct(), cards), "pairs")
    busy = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    # only documents in question are read as full sets
    sets = written(rows.join(reps.join(busy, "id", "left_semi"), "id")
                   .select("id", *key, full_sets(words)("t").alias("x"))
                   .where("x.n = n and x.d1 = d1 and x.d2 = d2").select("id", "n", "x.shingles"), "sets")
    nodes = merged(sets.select("id", F.col("id").alias("comp")).distinct(), written(confirm(pairs, sets), "links"))
    nodes = _across(large, nodes, sets, cards, pairs)
    label = (member.select("id", "rep").join(nodes.select(F.col("id").alias("rep"), "comp"), "rep", "left")
             .select("id", F.coalesce("comp", "rep").alias("label")))
    # the smallest id of all classes in the component (labels are representatives, the smallest of their class)
    return (told.select("id", "n").join(label, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("label", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _across(large: DataFrame, nodes: DataFrame, sets: DataFrame, cards: DataFrame, tried: DataFrame) -> DataFrame:
    """``nodes`` after comparing the members of large buckets that lie in different components."""
    placed = large.join(nodes, "id")
    split = (placed.groupBy("band", "h")
             .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n"),
                  F.max(F.struct("shares", "id", "comp")).alias("c"))
             .where("lo <> hi").select("band", "h", "least_n", F.col("c.comp").alias("main")))
    open_ = written(placed.join(split, ["band", "h"]).select("band", "h", "id", "n", "comp", "least_n", "main"), "open")
    if open_.isEmpty():
        return nodes
    # r: how many of its shingles a document has in common with any open document
    held = (sets.join(open_.select("id").distinct(), "id", "left_semi")
            .select("id", F.explode(unpacked("shingles")).alias("s")).distinct())
    lone = (held.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
            .groupBy("id").agg(F.count(F.lit(1)).alias("alone")))
    # overlap <= r, so similarity 0.8 needs 180 r >= 80 (n + the other's n)
    able = (open_.join(lone, "id", "left").withColumn("r", F.col("n") - F.coalesce("alone", F.lit(0)))
            .where("180 * r >= 80 * (n + least_n)").select("band", "h", "id", "n", "r", "comp", "main"))
    slots = cards.join(able.select("id").distinct(), "id", "left_semi").select("id", folded("card").alias("slots"), "bands")
    able = written(able.join(slots, "id").select("band", "h", "id", "n", "r", "comp", "slots", "bands", "main"), "able")
    left = able.where("comp <> main").toDF("band", "h", "a", "na", "ra", "pa", "ka", "ha", "main")
    right = able.withColumn("place", F.col("band") + 1).toDF("band", "h", "b", "nb", "rb", "pb", "kb", "hb", "mb", "place").withColumn("other", F.expr("pb <> mb")).drop("mb")
    # all bounds are part of the join: a pair that cannot be similar is never made, nor one that
    # meets in an earlier band (there it is made, was tried already, or has one component)
    fits = ("pa <> pb and (a < b or not other) and least(na, nb) * 100 >= greatest(na, nb) * 80 and 180 * least(ra, rb) >= 80 * (na + nb)"
            " and coalesce(180 * aggregate(zip_with(ka, kb, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
            " >= 80 * (na + nb), true)"
            " and array_position(zip_with(ha, hb, (x, y) -> x = y), true) = place")
    same = [left[c] == right[c] for c in ("band", "h")]
    pairs = (left.join(right, [*same, F.expr(fits)]).select(*_pair()).distinct()
             .join(tried, ["a", "b"], "left_anti"))
    return merged(nodes, written(confirm(written(possible(pairs, cards), "pairs"), sets), "links"))


def keep_first(docs: DataFrame, words: int = PIPELINE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: one document of each group stays.

    Rows without an id stay; of rows that repeat id and text, one stays; rows of one id
    with differing texts share the id's fate.
    """
    drop = groups(docs, words=words).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti")
    # ids that come more than once: only their rows are compared as a whole
    again = (docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").select("doc_id"))
    once = kept.join(again, "doc_id", "left_anti")
    first = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(first).select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS) -> dict[int, tuple[int, int]]:
    """Plain all-pairs version for tests: id -> (n_shingles, component_id)."""
    import re
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(fold))
        own[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(own)
    for p, i in enumerate(ids):
        for j in ids[p + 1:]:
            both = len(own[i] & own[j])
            if own[i] and 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(own[i]), find(i)) for i in ids}



def oracle_sql() -> str:
    """All pairs that share a shingle, exact sets, and components by reachability, in DuckDB SQL."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, GREATEST(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM both_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, m) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.m),
comp AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, LEAST(d.doc_id, COALESCE(component_id, d.doc_id)) AS component_id,
  d.doc_id = LEAST(d.doc_id, COALESCE(component_id, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id"""
