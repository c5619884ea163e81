"""Nearest neighbours with vantage-point trees per shard (operator 7).

Vectors are dealt to shards by a hash of their id. Each shard builds a
vantage-point tree: a vantage point, the distances of the others to it, and a
split into the nearer and the farther half; leaves hold up to ``LEAF`` vectors.
A query skips a half if the triangle inequality shows that its vectors lie
farther than ``tau / factor``, tau being the query's k-th best distance so far:
factor 1 restores exact search, larger factors prune more. Each shard answers
with its k nearest, and the shards' answers are merged.

Production uses factor 1: results are exact, ties included (a half is skipped
only if it lies strictly farther).

Scale. Queries come in blocks of a bounded size, and every pair of a block and
a shard is one group: vectors are copied once per block, queries once per
shard, and no group exceeds ``SHARD_ROWS`` + ``BLOCK_ROWS`` vectors. Equal
vectors cost no more than others: a split is by rank, not by radius.

Defined cases: null, empty or zero vectors and vectors with null, NaN or infinite
components take no part, nor do null ids; a query is answered among the vectors of
its own size; a distance beyond the largest double is infinite and ranks last; rows that repeat an
id are separate candidates, never for a query of the same id, and one query;
fewer candidates than k are all returned; without queries the result is empty.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
QUERY_STEP = 100
FACTOR = 1.0
LEAF = 48
SHARD_ROWS = 20_000
BLOCK_ROWS = 4_000
NO_ID = np.iinfo(np.int64).max  # a place without a candidate


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a (n, d) to b (d) or to each other row by row, summed in order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        diff = a[:, j] - (b[j] if b.ndim == 1 else b[:, j])
        out += diff * diff
    return np.sqrt(out)


class Tree:
    """Vantage-point tree over the rows of ``x``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, max(leaf, 4)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point, rest = rows[len(rows) // 2], np.delete(rows, len(rows) // 2)
        d = distances(self.x[rest], self.x[point])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        near, far = order[:half], order[half:]
        return (point, d[near[0]], d[near[-1]], d[far[0]], d[far[-1]], self._build(rest[near]), self._build(rest[far]))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """(distance, id) of the k nearest rows of each query, without rows of the query's own id."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        best_id = np.full((n, k), NO_ID)
        slack = 1 + 1e-9  # a bound must not prune by a rounding error

        def offer(active, rows):
            """Merge candidate rows into the answers of the active queries."""
            step = max(1, 200_000 // max(1, len(rows)))
            for lo in range(0, len(active), step):
                q = active[lo:lo + step]
                d = np.zeros((len(q), len(rows)))
                for j in range(queries.shape[1]):  # summed in order, as ``distances`` does
                    diff = queries[q, j][:, None] - self.x[rows, j][None, :]
                    d += diff * diff
                np.sqrt(d, out=d)
                own = query_ids[q][:, None] == ids[rows][None, :]
                d[own] = np.inf
                all_d = np.concatenate([best[q], d], axis=1)
                all_i = np.concatenate([best_id[q], np.where(own, NO_ID, ids[rows][None, :])], axis=1)
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best[q] = np.take_along_axis(all_d, order, 1)
                best_id[q] = np.take_along_axis(all_i, order, 1)

        def visit(node, active):
            if not len(active):
                return
            if not isinstance(node, tuple):
                offer(active, node)
                return
            point, near_lo, near_hi, far_lo, far_hi, near, far = node
            offer(active, np.array([point]))
            d = distances(queries[active], self.x[point])

            def below(lo, hi):  # smallest distance that a row of the half can have
                return np.maximum(0, np.maximum(lo - d, d - hi))
            halves = [(near_lo, near_hi, near), (far_lo, far_hi, far)]
            # the half that is more promising for most queries first: the block stays whole
            if (below(near_lo, near_hi) <= below(far_lo, far_hi)).mean() < 0.5:
                halves.reverse()
            for lo, hi, child in halves:
                # written so that bounds between infinite distances, which say nothing, do not prune
                visit(child, active[~(below(lo, hi) * factor > best[active, k - 1] * slack)])
        if len(self.x):
            visit(self.root, np.arange(n))
        return best, best_id


def _usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0))
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(good)


def nearest(table: DataFrame, k: int = K, factor: float = FACTOR, step: int = QUERY_STEP, id_col: str = "vec_id",
            vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``step``."""
    rows = _usable(table, id_col, vec_col)
    told = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"),
                                                  F.count_if(F.col("id") % step == 0).alias("q")).where("q > 0"))
    # shards and blocks of each size; a query is answered among the vectors of its own size
    told = told.select("d", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"),
                       F.ceil(F.col("q") / block_rows).cast("int").alias("blocks"))
    rows = rows.withColumn("d", F.size("v")).join(F.broadcast(told), "d")  # a row a size
    # hash dealing: a shard's size varies little around the mean; copies of an id are dealt apart
    shard = F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    data = (rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*[F.col(c).alias(c) for c in ("d", "shard", "block", "id", "v")]))
    ask = (rows.where(F.col("id") % step == 0).withColumn("block", block)
           .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
           .select(*[F.col(c).alias(c) for c in ("d", "shard", "block", "id", "v")]))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        # one query per id (of differing vectors the first by bytes)
        asked = asked.assign(_=[np.asarray(v, float).tobytes() for v in asked["v"]]).sort_values(["id", "_"])
        asked = asked.drop_duplicates("id")
        held = held.sort_values("id", kind="stable")
        x, ids = np.stack(held["v"].to_list()).astype(float), held["id"].to_numpy()
        queries, query_ids = np.stack(asked["v"].to_list()).astype(float), asked["id"].to_numpy()
        d, found = Tree(x).search(queries, query_ids, ids, k, factor)
        q, c = np.nonzero(found != NO_ID)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": found[q, c], "score": d[q, c]})

    answers = (ask.groupBy("d", "shard", "block").cogroup(data.groupBy("d", "shard", "block"))
               .applyInPandas(search, "query_id long, vec_id long, score double"))
    # k rows per query and shard
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (answers.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle_sql() -> str:
    """Brute force in DuckDB SQL; distances are summed in the order of the components."""
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
  lambda a, b: a + b)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
