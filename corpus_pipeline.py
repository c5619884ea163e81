"""The training-corpus pipeline: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; those that run Python hand it a few hundred rows at a time, which also
holds for the session afterwards (``run`` puts the setting back). ``run`` writes each stage's result as Parquet below the shared checkpoint
folder and reads it again as the next one's input, so a lost executor costs
the stage at hand only.

``ORACLE_SQL`` is None: SQL can express neither the classifier nor the sampled
segmentation; ``tests/llm/test_pipeline.py`` checks the stages against plain
versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderata.llm import lines, minhash, mixing, pieces, quality
from moderata.llm.common import BATCH, small_batches, table, written

BUDGET_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, accepts."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and near-repeated lines; documents left without a line go."""
    return lines.drop_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: runs of five words, similarity 0.8."""
    small_batches(spark)
    return minhash.keep_first(docs, minhash.PIPELINE_WORDS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token budget's share of each leaf, at most one epoch: no document comes twice."""
    return mixing.selected(docs, percent=BUDGET_PERCENT, epochs=1)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text again."""
    small_batches(spark)
    return pieces.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("sentencepiece_encoding", sentencepiece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH, before)
    return docs
