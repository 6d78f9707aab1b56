"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What every job of this package wants, whatever the size of the cluster. The number of shuffle
# partitions is left to the deployment: AQE merges small ones, so a high number is safe.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A page this deep is cut by a sort on the executors, not by a top-k merge on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Recording the Python line of every expression takes about half the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(app: str = "tracklight", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the package defaults; `extra` uses `__` for the dots of a setting name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors can reach, under the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="tracklight-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make `DataFrame.checkpoint()` usable, following `spark.checkpoint.dir`."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark, "checkpoint"))
