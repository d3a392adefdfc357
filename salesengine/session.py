"""Session construction and the shared storage root for written tables."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partitions are sized for the local
# test box; on a cluster the caller's session keeps its own value and AQE
# coalesces / splits partitions at runtime.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "salesengine") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SALESENGINE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    storage_root(spark)
    return spark


def storage_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; only a local-mode session without the
    setting (tests) gets a fresh private folder.  A cluster session must name
    a shared folder, since executors can be lost and their local disks with them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        root = _local_root(spark.sparkContext.applicationId)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root.rstrip("/") + "/rdd-checkpoints")
    return root.rstrip("/")


@functools.cache
def _local_root(application: str) -> str:
    """One private folder per local application (``spark.checkpoint.dir`` cannot be set in a running session)."""
    return tempfile.mkdtemp(prefix="salesengine-")


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session (the server owns it)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


# Runtime SQL settings for a large cluster (100 TB inputs, ~1000 executors).  They only
# size partitions and let AQE act; results do not depend on them.
SCALE_SETTINGS = {
    # big scan splits and shuffle targets: fewer, fuller tasks; AQE coalesces small ones
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.shuffle.partitions": "16384",
    # split a skewed join partition even when that costs one more shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast only what the planner measured small
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # a selective filter on one side of a join thins the other side's scan by a Bloom filter: sizes are those of the
    # unfiltered side, so allow for large tables; 64 MB of bits at most
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "60000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 29),
}


def configure_for_scale(spark: SparkSession, **overrides: str) -> SparkSession:
    """Apply ``SCALE_SETTINGS`` (and overrides) to an existing cluster session."""
    for k, v in {**SCALE_SETTINGS, **overrides}.items():
        spark.conf.set(k, v)
    storage_root(spark)
    return spark


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared folder (made sure of first); never a local checkpoint."""
    storage_root(df.sparkSession)
    return df.checkpoint(eager=True)
