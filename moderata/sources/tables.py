"""Readers for the given tables and the message views derived from them.

The driver tables stand in for the reference's inputs:

* ``documents``     -> chat messages (guild = source, channel = lang,
                       author = doc_id % 7, message order = doc_id)
* ``conversations`` -> a second message source with true turn order; the
                       assistant turns are the bot's own messages
* ``events``        -> a timestamped message stream (guild = event_type,
                       author = user_id, text = props)
* ``labels``        -> toxicity targets for training / evaluation
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import CLASSES
from ..functions.columns import hash_int, hash_unit, let, once

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

N_FIXTURE_AUTHORS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row text work at least one split per core.

    A scan yields one task per file split (row group). Large inputs already
    have far more splits than cores, and this is a no-op; a small input
    packed in few row groups would otherwise run on one core. Round-robin
    repartitioning is deterministic under task retry (rows are sorted first).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except PySparkException:  # no RDD view (a Spark Connect session): leave as is
        return df
    if splits < 2 * cores:
        return df.repartition(cores)
    return df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for per-row text work (tokenising, regex, UDFs)."""
    return spread(table(spark, sf_dir, name))


def messages_from_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("message_id"),
        F.col("source").alias("guild"),
        F.col("lang").alias("channel"),
        (F.col("doc_id") % F.lit(N_FIXTURE_AUTHORS)).alias("author"),
        F.lit(False).alias("author_is_bot"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("text"),
    )


BOT_AUTHOR = 6  # the fixture messages' own account
CHAT_KINDS = 20


def chat_from_documents(docs: DataFrame) -> DataFrame:
    """Messages of every kind the gates and routes know, by a hash of the id:
    commands, image prompts, empty texts, apologies, bots, messages outside a
    guild; the bot's own account is ``BOT_AUTHOR``; the rest are plain."""
    m = once(messages_from_documents(docs), {"kind": hash_int("message_id", "kind") % CHAT_KINDS})
    kind = F.col("kind")
    text = (F.when(kind == 0, F.concat(F.lit("%"), "text"))
            .when(kind == 1, F.concat(F.lit("Toxic SHOW ME "), "text"))
            .when(kind == 2, F.concat(F.lit("toxicbot show me "), "text"))
            .when(kind == 3, F.lit(""))
            .when(kind == 4, F.concat("text", F.lit(" Sorry, sorry for being Toxic")))
            .otherwise(F.col("text")))
    return (m.withColumn("text", text).withColumn("author_is_bot", kind == 5)
            .withColumn("guild", F.when(kind != 6, F.col("guild"))).drop("kind"))


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    """guild = conversation, channel = role, author = a role code, order = turn;
    ``message_id`` is the string ``conv_id:turn``."""
    role_code = (F.when(F.col("role") == "user", 1)
                 .when(F.col("role") == "assistant", 0)
                 .otherwise(2).cast("bigint"))
    return conv.select(
        F.concat_ws(":", "conv_id", "turn").alias("message_id"),
        F.col("conv_id").cast("string").alias("guild"),
        F.col("role").alias("channel"),
        role_code.alias("author"),
        (F.col("role") == F.lit("system")).alias("author_is_bot"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("text"),
    )


def messages_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("message_id"),
        F.col("event_type").alias("guild"),
        F.lit("events").alias("channel"),
        F.col("user_id").alias("author"),
        F.lit(False).alias("author_is_bot"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("props").alias("text"),
    )


def chat_from_events(events: DataFrame) -> DataFrame:
    """The event stream with commands, apologies, bots and late messages (60 days back) by a hash of the id."""
    m = once(messages_from_events(events), {"kind": hash_int("message_id", "kind") % CHAT_KINDS})
    kind = F.col("kind")
    text = (F.when(kind == 0, F.concat(F.lit("%"), "text"))
            .when(kind == 1, F.concat(F.lit("Toxic SHOW ME "), "text"))
            .when(kind == 3, F.lit(""))
            .when(kind == 4, F.concat("text", F.lit(" sorry for being Toxic")))
            .otherwise(F.col("text")))
    late = F.when(kind == 7, F.col("ts") - F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts"))
    return m.withColumn("text", text).withColumn("author_is_bot", kind == 5).withColumn("ts", late).drop("kind")


FAIL_EVERY = 25


def fixture_scores(messages: DataFrame) -> DataFrame:
    """Shared test scores: a hash of (message_id, class) to the fourth power.

    Not a model: a stand-in scorer whose numbers are the same bit for bit in
    Spark and DuckDB, so ledger and action operators can be oracle-checked.
    One message in ``FAIL_EVERY`` gets no scores, as when the scorer fails.
    """
    works = F.col("message_id") % FAIL_EVERY != 11

    def squared(x):
        return let(x, lambda v: v * v)
    return once(messages, {c: F.when(works, squared(squared(hash_unit("message_id", c)))) for c in CLASSES})


def stats_requests_from_documents(docs: DataFrame) -> DataFrame:
    """A ``%stats`` request per document: no mention (guild report), one or two
    mentioned authors, chosen by the document id."""
    third = F.expr("doc_id div 3")
    first = third % N_FIXTURE_AUTHORS
    second = (third + 2) % N_FIXTURE_AUTHORS
    k = F.col("doc_id") % 3
    mentions = (F.when(k == 0, F.array().cast("array<bigint>"))
                .when(k == 1, F.array(first))
                .otherwise(F.array(first, second)))
    return docs.select(F.col("doc_id").alias("request_id"), F.col("source").alias("guild"),
                       mentions.alias("mentions"))


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the training CSV, derived from ``documents`` + ``labels``.

    comment_text = document text; ``toxic`` = the label table's toxic flag;
    the other six soft labels are the toxic flag times a hash of (doc, class);
    identity labels are NULL for 60 % of (doc, group) pairs (hash), else a
    value in [0, 1); reaction counts are hash mod 10. Only labelled documents
    are used (inner join).
    """
    from ..functions.classes import IDENTITY_COLUMNS, REACTION_COLUMNS
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = docs.join(labels, "doc_id")
    cols = [F.col("doc_id").alias("id"), F.col("text").alias("comment_text"),
            F.col("toxic").cast("double").alias("toxic")]
    for c in CLASSES[1:]:
        cols.append((F.col("toxic").cast("double") * hash_unit("doc_id", "label:" + c)).alias(c))
    for c in IDENTITY_COLUMNS:
        v = hash_unit("doc_id", "identity:" + c)
        cols.append(F.when(v >= 0.6, (v - F.lit(0.6)) / F.lit(0.4)).alias(c))
    for c in REACTION_COLUMNS:
        cols.append((hash_int("doc_id", "reaction:" + c) % 10).cast("int").alias(c))
    return j.select(*cols)


def image_requests_from_documents(docs: DataFrame) -> DataFrame:
    """An image request per document: the whole text is the prompt; size,
    steps and scale come from hashes of the id, some left NULL (defaults)."""
    hh, hw = hash_int("doc_id", "h"), hash_int("doc_id", "w")
    hs, hc = hash_int("doc_id", "steps"), hash_int("doc_id", "scale")
    return docs.select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"),
        F.when(hh % 5 != 0, (F.lit(128) * (hh % 32 + 1)).cast("int")).alias("h"),
        F.when(hw % 5 != 0, (F.lit(128) * (hw % 32 + 1)).cast("int")).alias("w"),
        F.when(hc % 3 != 0, (hc % 100) / F.lit(10.0)).alias("scale"),
        F.when(hs % 7 != 0, (hs % 300 + 1).cast("int")).alias("ddim_steps"),
        F.lit(None).cast("int").alias("n"), F.lit(None).cast("double").alias("cond_scale"))
