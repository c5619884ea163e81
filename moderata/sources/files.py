"""File sources: training CSV, persona JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import CLASSES, TRAINING_TOXICITY_COLUMNS
from . import schemas

PERSONA_CONFIG = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(
    os.path.abspath(__file__)))), "conf", "personas.json")


CORRUPT = "_corrupt_record"


def _training_raw(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the file, typed by column name, malformed ones with their text in ``_corrupt_record``.

    The header is read once; columns come in file order, unknown ones as text.
    """
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = {f.name: f for f in schemas.TRAINING_CSV.fields}
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in head.columns]
    missing = sorted(set(known) - set(head.columns))
    if "comment_text" in missing:
        raise ValueError(f"{path}: no column comment_text")
    raw = (spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
           .option("header", True).option("multiLine", True).option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    for c in missing:
        raw = raw.withColumn(c, F.lit(None).cast(known[c].dataType))
    return raw


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training CSV by column name (any order, extra columns ignored, absent
    ones NULL); quoted multi-line comments; malformed rows are left to
    ``corrupt_training_rows``, so no bad value turns into a label.

    Multi-line CSV files cannot be split, so convert once to Parquet
    (``training_csv_to_parquet``) and train from that. The second toxicity
    class is renamed to the ledger spelling.
    """
    df = _training_raw(spark, path).where(F.col(CORRUPT).isNull()).select(*[f.name for f in schemas.TRAINING_CSV.fields])
    for src, dst in zip(TRAINING_TOXICITY_COLUMNS, CLASSES):
        if src != dst:
            df = df.withColumnRenamed(src, dst)
    return df


def corrupt_training_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the file whose values do not fit the schema, as text."""
    raw = _training_raw(spark, path)
    # Spark parses only the columns that are read: ask for all of them
    fields = F.struct(*[F.col(f.name) for f in schemas.TRAINING_CSV.fields])
    return raw.select(F.col(CORRUPT).alias("line"), F.xxhash64(fields).alias("parsed")).where(F.col("line").isNotNull())


def training_csv_to_parquet(spark: SparkSession, src: str, dst: str,
                            partitions: int | None = None) -> DataFrame:
    """Convert the training CSV once to Parquet: a multi-line CSV file is read
    by one task per file, the Parquet copy splits by row group and prunes
    columns. ``partitions`` spreads the rows before writing (round robin)."""
    df = read_training_csv(spark, src)
    if partitions:
        df = df.repartition(partitions)
    df.write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def load_persona_config(path: str = PERSONA_CONFIG, spark: SparkSession | None = None) -> dict:
    """The configuration (one small JSON file): personas and reply lists.

    With a session the file may lie in any storage that Spark reads; without
    one it is a file beside the package.
    """
    if spark is not None:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def reply_lists(config: dict) -> dict[str, list[str]]:
    """The configured reply lists, as arguments of ``actions.actions``; absent ones keep the defaults."""
    names = {"toxic": "toxic_replies", "apology": "apology_replies"}
    return {arg: list(config[key]) for key, arg in names.items() if config.get(key)}


def persona_rows(config: dict) -> list[tuple]:
    users = config.get("user", {})
    rows = []
    for key, val in users.items():
        if key in ("all", "p_default") or not isinstance(val, dict):
            continue
        rows.append((int(key), val.get("_name_"), val.get("p"), list(val.get("resps", []))))
    return rows


def personas(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(persona_rows(config), schemas.PERSONA)
