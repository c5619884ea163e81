"""Spark session helpers.

On a cluster the session comes from the platform; these helpers only fill in
settings that are unset, so tests and local runs behave like a cluster job.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that a local run needs and a cluster usually already has.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # texts can be long: keep Arrow batches for pandas UDFs modest
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "moderata", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("MODERATA_DRIVER_MEM", "16g")))
    for k, v in {**LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform and points at shared storage.
    Only a local-mode session (tests, benchmark) without it gets a fresh
    scratch folder; a cluster session without it is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return cur or ""
    if not cur:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder")
        cur = tempfile.mkdtemp(prefix="moderata-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", cur)
    sc.setCheckpointDir(cur)
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared checkpoint folder for job outputs."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
