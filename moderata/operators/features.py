"""Feature operators: cyclic (positional) encoding and vector pooling.

Both are written with higher-order array functions or long-format hash
aggregates, so they stay in the JVM and scale with rows and groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cyclic_encoding(x: Column, resolution: int = 64) -> Column:
    """Array of ``resolution`` values; x / 10000^(i/resolution), sine at
    even i and cosine at odd i."""
    idx = F.sequence(F.lit(0), F.lit(resolution - 1))

    def enc(i):
        arg = x / F.pow(F.lit(10000.0), i.cast("double") / F.lit(float(resolution)))
        return F.when(i % 2 == 0, F.sin(arg)).otherwise(F.cos(arg))
    return F.transform(idx, enc)


def positional_encoding(df: DataFrame, pos_col: str, dims: int = 128) -> DataFrame:
    """Positional encoding of an integer position column."""
    return df.withColumn("pos_enc", cyclic_encoding(F.col(pos_col).cast("double"), dims))


def pooled_vectors(df: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """(keys, mean ARRAY, max ARRAY) per group -- mean ‖ max pooling.

    Whole vectors are aggregated by Spark ML's ``Summarizer`` (partial
    aggregation per task, then a merge), so no row-per-dimension explode
    happens before the shuffle and a hot group costs one partial vector per
    map task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    summ = Summarizer.metrics("mean", "max")
    g = (df.select(*keys, array_to_vector(F.col(vec)).alias("_v"))
         .groupBy(*keys).agg(summ.summary(F.col("_v")).alias("_s")))
    return g.select(*keys, vector_to_array(F.col("_s.mean")).alias("mean"),
                    vector_to_array(F.col("_s.max")).alias("max"))


def vector_pool(df: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """T13 in long form (keys, pos, mean, max); only the per-group results
    are exploded."""
    both = F.arrays_zip(F.col("mean").alias("mean"), F.col("max").alias("max"))
    return (pooled_vectors(df, keys, vec)
            .select(*keys, F.posexplode(both).alias("pos", "m"))
            .select(*keys, F.col("pos").cast("bigint").alias("pos"),
                    F.col("m.mean").alias("mean"), F.col("m.max").alias("max")))


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)
