"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app_name: str = "barograph", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators are tuned for.

    Only names that the cluster has not set are worth passing in ``conf``; the
    number of shuffle partitions is left to adaptive execution.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Pages reach Python in batches bounded by bytes, not only by rows.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        # Keys of unfinished windows and duplicates live on disk, not on the heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster shares through ``spark.checkpoint.dir``.

    A machine-local folder is used only where no shared one is configured and
    the session runs in one process; on a cluster that is an error, because
    executors could not read each other's files.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barograph-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
