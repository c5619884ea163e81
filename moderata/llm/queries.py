"""Registered queries of the corpus operators: one ``opN_<name>`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    collisions, langid, licenses, lines, minhash, mixing, outliers, periods, pieces, pii, quality, spelling, vptree)
from .common import table


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), words=minhash.WORDS)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op1_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (periods.runs_per_document(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
                    "n_words", "n_dropped"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.groups(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_license_scan, op3_quality, op4_quality_rules, op5_language_id, op6_pii, op7_vptree,
    op8_minhash, op9_mixing, op10_sentencepiece, op11_spelling_variants, op12_periodic_runs, op13_embedding_near_dedup,
    op1_line_classes)}
LLM_SQL: dict[str, str] = {"op1_line_dedup": lines.oracle_sql(), "op8_minhash": minhash.oracle_sql(), "op4_quality_rules": outliers.oracle_sql(), "op7_vptree": vptree.oracle_sql(), "op9_mixing": mixing.oracle_sql(),
                            "op11_spelling_variants": spelling.oracle_sql(),
                            "op13_embedding_near_dedup": collisions.oracle_sql()}
