"""Near-duplicate vectors by collision-counting projections (operator 13).

Vectors are scaled to length one and projected on random directions, where two
vectors of cosine 0.9 lie N(0, 0.2) apart whatever the data. For every one of
``WINDOWS`` directions the values are sorted and each vector, as a query, opens
a window of one standard deviation around its own value. A pair that meets in at
least ``needed()`` windows is a candidate; that number is the largest one which a
pair at the threshold reaches with probability 1 - ``MISS_COUNT`` (a binomial
tail). Candidates are verified by their cosine in double precision.

Counting all pairs would be quadratic. Vectors are therefore dealt to cells:
in each of some tables, ``bits`` further directions are split at the median of their
sorted values. ``calibrated()`` measures, on a bounded sample, how often the
window of a vector crosses those splits, and takes the number of tables that
leaves a pair at the threshold together in some cell with probability
1 - ``MISS_CELL`` and the number of bits of least work (the work per vector grows with
about the fifth root of the table). A pair counts in the first table that
it shares only.

Scale. Equal vectors are one class from the start, so copies cost nothing. A
cell larger than ``BLOCK`` is cut into blocks, and pairs of blocks are tasks of
their own; a task holds at most two blocks. Pairs never become rows: a task
returns, per vector with a link, its number of links there and one edge to the
smallest linked id, at most one row per vector and task. Components come from
these edges. To the driver go the number of vectors per size and one model
(some kB) per size. A group of g differing near copies has g^2 / 2 links to count,
which no method avoids; they are counted in numpy, block by block.

Defined cases: null, empty and zero vectors and vectors with null, NaN or infinite
components link with nothing (0 links, their own component, kept); a null id
does the same and gets a null component; vectors of different sizes do not link;
rows that repeat an id and vector count once and get the same answer; differing
vectors of one id are compared like others, and share a component; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .minhash import merged

COSINE = 0.9
WINDOWS = 40          # directions in which collisions are counted
MISS_COUNT = 5e-4     # share of pairs at the threshold lost by the count
MISS_CELL = 2e-3      # share of pairs at the threshold that share no cell
SAMPLE = 4_096        # vectors of each size on which cells are calibrated
COPY_COST = 800       # one more copy of a vector costs as much as this many pairs
BLOCK = 1_024
SEED = 13
MAX_BITS, MAX_TABLES = 30, 512


def spread(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors' projections."""
    return math.sqrt(2 - 2 * cosine)


def needed(windows: int = WINDOWS, miss: float = MISS_COUNT) -> int:
    """The most collisions that a pair at the threshold reaches with probability 1 - miss."""
    p, tail = math.erf(1 / math.sqrt(2)), 0.0  # a window of one standard deviation
    for k in range(windows + 1):
        tail += math.comb(windows, k) * p**k * (1 - p)**(windows - k)
        if tail > miss:
            return k
    return windows


def directions(size: int, kind: int, count: int) -> np.ndarray:
    """``count`` fixed random directions; the first ones do not depend on ``count``."""
    return np.random.default_rng([SEED, kind, size]).standard_normal((count, size))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a power of two first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def projected(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Projections row by row: a row's values do not depend on the rows beside it."""
    return np.einsum("ij,kj->ik", x, on, optimize=False)


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (a logistic form, within 0.0002)."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -500, 500)))


def calibrated(x: np.ndarray, total: int, cosine: float = COSINE) -> dict:
    """Bits, tables and splits for ``total`` vectors, measured on the unit vectors ``x``."""
    size, best = x.shape[1], None
    most = max(0, min(MAX_BITS, int(math.log2(max(total, 1)))))
    share, seen = np.sqrt(1 - cosine * cosine), {}

    def direction(j: int):
        """Split of direction j and how probably each vector's partner lies on its side."""
        if j not in seen:
            if j >= len(known[0]):
                known[0] = directions(size, 1, 2 * j + 64)
            own = projected(x, known[0][j:j + 1])[:, 0]
            split = float(np.median(own))
            z = (cosine * own - split) / share  # a partner's value is N(cosine * own, 1 - cosine^2)
            seen[j] = split, np.where(own > split, _below(z), 1 - _below(z))
        return seen[j]
    known = [directions(size, 1, 64)]
    for bits in range(most + 1):
        miss, tables = np.ones(len(x)), 0
        while tables < (MAX_TABLES if bits else 1):
            together = np.ones(len(x))
            for j in range(tables * bits, (tables + 1) * bits):
                together = together * direction(j)[1]
            miss, tables = miss * (1 - together), tables + 1
            cost = tables * (total / 2**bits + COPY_COST)
            if miss.mean() <= MISS_CELL or (best and cost >= best[0]):
                break
        if miss.mean() <= MISS_CELL and (best is None or cost < best[0]):
            best = cost, bits, tables
        elif best and tables * COPY_COST > best[0]:
            break
    _, bits, tables = best
    return {"bits": bits, "tables": tables, "splits": [direction(j)[0] for j in range(bits * tables)]}


def collided(x: np.ndarray, on: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet in at least ``least`` windows: sort each projection, count neighbours in reach."""
    n = len(x)
    counts = np.zeros(n * n, dtype=np.uint8)
    values = projected(x, on)
    for j in range(len(on)):
        order = np.argsort(values[:, j], kind="stable")
        line = values[order, j]
        reach = np.searchsorted(line, line + width, side="right") - np.arange(1, n + 1)
        here = np.repeat(np.arange(n), reach)
        there = np.arange(len(here)) - np.repeat(np.cumsum(reach) - reach, reach) + here + 1
        a, b = order[here], order[there]
        counts[np.minimum(a, b) * n + np.maximum(a, b)] += 1  # a pair meets once in a projection
    pairs = np.flatnonzero(counts >= least)
    return pairs // n, pairs % n


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for lo in range(0, len(a), 50_000):
        out[lo:lo + 50_000] = np.einsum("ij,ij->i", x[a[lo:lo + 50_000]], x[b[lo:lo + 50_000]])
    return out


def smallest_linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by the links (a, b)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _usable(vec):
    return (vec.isNotNull() & (F.size(vec) > 0) & F.exists(vec, lambda c: c != 0)
            & ~F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _models(vectors: DataFrame, cosine: float) -> dict[int, dict]:
    """Size -> cell model; the sample of each size is calibrated where it lies."""
    totals = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return {}

    def calibrate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(rows["v"].to_list()).astype(float))
        m = calibrated(x, totals[int(key[0])], cosine)
        return pd.DataFrame({"size": [int(key[0])], "bits": [m["bits"]], "tables": [m["tables"]], "splits": [m["splits"]]})
    share = F.create_map(*[F.lit(c) for size, n in totals.items() for c in (size, SAMPLE / n)])
    lot = F.pmod(F.col("d2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = (vectors.where((lot < share[F.col("size")]) | (F.col("size").isin([s for s, n in totals.items() if n <= SAMPLE])))
             .select("size", F.col("v").cast("array<double>").alias("v"))
             .groupBy("size").applyInPandas(calibrate, "size int, bits int, tables int, splits array<double>"))
    models = {r["size"]: {"bits": r["bits"], "tables": r["tables"], "splits": list(r["splits"])} for r in found.collect()}
    # a size that the sample happens to miss: one cell holds all
    return {s: models.get(s, {"bits": 0, "tables": 1, "splits": []}) for s in totals}


def _placed(models: dict[int, dict], kind: str):
    """pandas UDF: the packed vector and its cell in every table."""
    def place(vectors: pd.Series) -> pd.DataFrame:
        packed, cells = [None] * len(vectors), [None] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            at, m = np.flatnonzero(sizes == size), models[int(size)]
            raw = np.stack([vectors.iloc[k] for k in at])
            used = m["bits"] * m["tables"]
            own = projected(unit(raw.astype(float)), directions(int(size), 1, used)) > np.array(m["splits"])[None, :]
            code = (own.reshape(len(at), m["tables"], m["bits"]) << np.arange(m["bits"])).sum(axis=2)
            for k, row, keys in zip(at, raw.astype(kind), code.astype(np.int32)):
                packed[k], cells[k] = row.tobytes(), keys
        return pd.DataFrame({"packed": pd.Series(packed, dtype=object), "cells": pd.Series(cells, dtype=object)})
    return F.pandas_udf(place, T.StructType([T.StructField("packed", T.BinaryType()),
                                             T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _linked(cosine: float, kind: str):
    """Links within one task's vectors: per vector its number of links and the smallest id reached."""
    least = needed()

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table, i, j = int(key[1]), int(key[3]), int(key[4])
        rows = rows.sort_values(["id", "d1"], kind="stable")
        raw = np.frombuffer(b"".join(rows["packed"]), kind).reshape(len(rows), int(key[0]))
        x = unit(raw.astype(float))
        a, b = collided(x, directions(x.shape[1], 2, WINDOWS), spread(cosine), least)
        side = rows["part"].to_numpy()
        if i != j:  # pairs within one block belong to that block's own task
            a, b = (c[side[a] != side[b]] for c in (a, b))
        if table and len(a):
            earlier = np.stack(rows["cells"].to_list())[:, :table]
            fresh = np.ones(len(a), bool)
            for t in range(table):
                fresh &= earlier[a, t] != earlier[b, t]
            a, b = a[fresh], b[fresh]
        near = cosines(x, a, b) >= cosine
        a, b = a[near], b[near]
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        links = (np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))).astype(np.int64)
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "d1": rows["d1"].to_numpy()[at], "links": links[at],
                             "root": smallest_linked(ids, a, b)[at]})
    return search


def groups(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
           block: int = BLOCK) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    element = table.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    vec = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("v")).withColumn("ok", F.col("id").isNotNull() & _usable(F.col("v")))
    # two digests name a vector (zero and minus zero alike)
    plain = F.transform("v", lambda c: F.when(c == 0, F.lit(0).cast(element)).otherwise(c))
    known = (rows.where("ok").select("id", "v", F.xxhash64(plain).alias("d1"),
                                     F.xxhash64(F.lit(SEED), F.reverse(plain)).alias("d2")))
    named = known.select("id", "d1", "d2").distinct()
    classes = written(named.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    vectors = written(known.join(classes, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"])
                      .withColumn("size", F.size("v")), "vectors")
    models = _models(vectors, cosine)
    if not models:
        found = written(classes.select("d1", "d2", "id", "copies", F.lit(0).cast("long").alias("links"),
                                       F.col("id").alias("comp")), "answers")
    else:
        placed = (vectors.select("id", "d1", "copies", "size", _placed(models, kind)("v").alias("x"))
                  .select("id", "d1", "copies", "size", "x.packed", "x.cells"))
        placed = written(placed, "placed")
        split = placed.select("*", F.posexplode("cells").alias("t", "cell"))
        cell = ["size", "t", "cell"]
        crowd = split.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # a cell of n vectors has ceil(n / block) blocks; each pair of blocks is a task
        parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
        tasks = (split.join(crowd.select(*cell, parts.alias("parts")), cell)
                 .withColumn("part", F.pmod(F.xxhash64("id", "d1"), F.col("parts")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select(*cell, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                         "id", "d1", "copies", "packed", "cells", "part"))
        told = written(tasks.groupBy(*cell, "i", "j").applyInPandas(_linked(cosine, kind),
                                                                  "id long, d1 long, links long, root long"), "links")
        links = told.groupBy("id", "d1").agg(F.sum("links").alias("links"))
        nodes = classes.select("id", F.col("id").alias("comp")).distinct()
        comps = merged(nodes, told.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
        found = written(classes.join(links, ["id", "d1"], "left").join(comps, "id")
                        .select("d1", "d2", "id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "comp"),
                        "answers")
    # classes with a thousandth of all rows or more (a thousand at most) are sent to the rows; the others meet them by key
    total = table.count()
    answer = found.select("d1", "d2", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("comp").alias("component_id"), "copies")
    often = answer.where(F.col("copies") * 1000 >= total).drop("copies")
    seldom = answer.where(F.col("copies") * 1000 < total).drop("copies")
    tagged = known.select("id", "d1", "d2").join(F.broadcast(often), ["d1", "d2"], "left")
    out = ["id", "n_links", "component_id"]
    met = tagged.where("n_links is not null").select(*out).union(
        tagged.where("n_links is null").select("id", "d1", "d2").join(seldom, ["d1", "d2"]).select(*out))
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (met.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id")
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def oracle_sql() -> str:
    """Every pair in DuckDB SQL; links of equal ids are not expected in the tables it runs on."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, m) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.m),
comp AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, COALESCE(comp.component_id, e.vec_id) AS component_id,
  COALESCE(e.vec_id = COALESCE(comp.component_id, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN comp ON comp.id = e.vec_id"""


def brute_force(rows: list[tuple[int, list[float]]], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """Plain all-pairs version for tests: id -> (n_links, component_id)."""
    ids = np.array([i for i, _ in rows])
    x = unit(np.array([v for _, v in rows], float))
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), smallest_linked(ids, a, b))}
