"""The incident ledger and the reactions as Structured Streaming queries.

Each output is one query over the same messages: repeated messages are dropped,
the others take the way of a batch run (``operators.flow``): gates -> route ->
score -> quarantine. What a table is made of decides where it is kept:

* ``users``: counters per (guild, author), a streaming aggregation in update
  mode. The state store is the table; ``current_users`` reads it.
* ``last``: the latest message per (guild, author, channel), a streaming
  aggregation too (the largest of time, id and text together);
  ``current_last_messages`` reads that state.
* ``history``, ``actions``, ``quarantine``: rows that are only ever added, by
  Spark's file sink, whose log says which files count.

Restarts, replays and half-written batches are Spark's own business: state and
file log move by whole micro-batches. Sums and maxima do not depend on the order
of messages, and there is no watermark: no message is too late to count.

Seen ids: by default every message id is remembered (``dropDuplicates``). With
``seen_ttl_ms`` an id is forgotten that long after its first arrival, which bounds
the state by the traffic of that time. State lies in RocksDB, on the executors'
disks and in the checkpoint folder, not in their memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.classes import PERSONA_P_DEFAULT
from ..operators import actions as A
from ..operators import ledger as L
from ..operators.flow import Flow, Scorer, process
from ..sources import schemas
from ..sources import tables as TB

OUTPUTS = ("users", "last", "history", "actions", "quarantine")
MAX_FILES_PER_TRIGGER = 1000
SEEN_BUCKETS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def event_source(spark: SparkSession, directory: str, glob: str = "*.parquet",
                 max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Raw events; a backlog is cut into micro-batches of ``max_files_per_trigger`` files.

    Every micro-batch commits each partition of the state, so few files a batch make many commits.
    """
    return (spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(directory))


class Unseen(StatefulProcessor):
    """Passes on the first row of each message id; ids are forgotten after ``ttl_ms``."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "message_id long", "first boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        for row in rows:
            if not self.seen.containsKey((row["message_id"],)):
                self.seen.updateValue((row["message_id"],), (True,))
                yield row

    def close(self) -> None:
        pass


def unseen(messages: DataFrame, seen_ttl_ms: int | None = None) -> DataFrame:
    """Each message once: for ever, or within ``seen_ttl_ms`` of its first arrival.

    With a time to live, ids share ``SEEN_BUCKETS`` keys, so a micro-batch calls
    the processor once a bucket, not once a message.
    """
    if seen_ttl_ms is None:
        return messages.dropDuplicates(["message_id"])
    dealt = messages.withColumn("_bucket", F.pmod(F.xxhash64("message_id"), F.lit(SEEN_BUCKETS)))
    return dealt.groupBy("_bucket").transformWithState(
        Unseen(seen_ttl_ms), dealt.schema, "Update", "ProcessingTime").drop("_bucket")


def latest_messages(scored: DataFrame) -> DataFrame:
    """The latest message per key as stream state (input: a stream of scored messages); keys with new messages are passed on."""
    at = F.coalesce(F.unix_micros("ts"), F.lit(-(10 ** 16)))  # no time: before any time
    return (scored.select("guild", "author", "channel", F.struct(at.alias("at"), "message_id", "text").alias("m"))
            .groupBy("guild", "author", "channel").agg(F.max("m").alias("m"))
            .select("guild", "author", "channel", "m.message_id", "m.text"))


def _rows(name: str, flow: Flow, personas, pool_all, p_default, replies) -> DataFrame:
    if name == "users":
        return L.ledger(flow.scored)
    if name == "last":
        return latest_messages(flow.scored)
    if name == "history":
        return L.history(flow.scored)
    if name == "actions":
        return A.action_rows(flow.judged, personas, pool_all, p_default, **(replies or {}))
    return flow.quarantine.select(*[f.name for f in schemas.MESSAGE.fields])


def start(messages: DataFrame, base: str, name: str, scorer: Scorer = TB.fixture_scores,
          bot_user_id: int | None = None, personas: DataFrame | None = None, pool_all=(),
          p_default: float = PERSONA_P_DEFAULT, replies: dict | None = None,
          seen_ttl_ms: int | None = None, available_now: bool = True,
          changes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the query of one output below ``base``.

    ``changes(rows, batch_id)`` receives the changed rows of ``users`` and ``last``
    after each micro-batch (at least once), for example to upsert them elsewhere.
    """
    spark = messages.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
        spark.conf.set(CHANGELOG, "true")
    if seen_ttl_ms is not None:  # a time to live asks for batches without data for ever, so none would be the last
        spark.conf.set(NO_DATA_BATCHES, "false")
    rows = _rows(name, process(unseen(messages, seen_ttl_ms), scorer, bot_user_id), personas, pool_all, p_default, replies)
    w = rows.writeStream.option("checkpointLocation", f"{base}/{name}/checkpoint")
    if name in ("users", "last"):
        w = w.outputMode("update")
        w = w.foreachBatch(changes) if changes else w.format("noop")
    else:
        w = w.outputMode("append").format("parquet").option("path", f"{base}/{name}/rows")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_all(messages: DataFrame, base: str, outputs=OUTPUTS, **options) -> dict[str, StreamingQuery]:
    return {name: start(messages, base, name, **options) for name in outputs}


def run_to_end(queries: StreamingQuery | dict[str, StreamingQuery]) -> None:
    """Wait for ``availableNow`` queries and surface their failures."""
    for q in queries.values() if isinstance(queries, dict) else [queries]:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


def _state(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """Keys and values of a query's state after its last complete micro-batch."""
    state = spark.read.format("statestore").load(f"{base}/{name}/checkpoint")
    return state.select("key.*", F.col("value").cast(schema).alias("value")).select("*", "value.*").drop("value")


def current_users(spark: SparkSession, base: str) -> DataFrame:
    counters = ", ".join(f"`{c}`: bigint" for c in L.COUNTERS)
    return _state(spark, base, "users", f"struct<{counters}>")


def current_last_messages(spark: SparkSession, base: str) -> DataFrame:
    m = "struct<at: bigint, message_id: bigint, text: string>"
    return _state(spark, base, "last", f"struct<m: {m}>").select("guild", "author", "channel", "m.message_id", "m.text")


def appended(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of ``history``, ``actions`` or ``quarantine`` that complete micro-batches added."""
    schema = {"history": schemas.HISTORY, "actions": schemas.ACTIONS, "quarantine": schemas.MESSAGE}[name]
    try:
        return spark.read.schema(schema).parquet(f"{base}/{name}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
