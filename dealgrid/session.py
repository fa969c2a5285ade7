"""Spark session and shared-storage helpers.

Everything in the library takes a SparkSession from the caller.  ``get_session``
is only a convenience for tests, the bench and the driver contract; on a real
cluster the session comes from spark-submit and its settings win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library assumes.  AQE re-plans joins from runtime sizes (its
# broadcast threshold is the size check for dimension tables that grow with the
# data), splits skewed join partitions and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "dealgrid") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DEALGRID_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the operator.
    Only when it is unset (local tests) a fresh scratch folder is created and
    registered as the checkpoint dir.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="dealgrid-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused, never cleared)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run sized from the input volume.

    * scan splits of ``target_partition_bytes`` (``spark.sql.files.maxPartitionBytes``);
    * shuffle partitions: one per target size of input, at least 2 waves of the
      cores, rounded to a multiple of the cores -- AQE coalesces small ones and
      splits skewed ones at run time;
    * broadcast threshold kept at 64 MB: dimension tables above it are shuffled.

    For 100 TB on 1,000 executors x 8 cores: ~400k shuffle partitions of ~256 MB.
    """
    cores = max(1, int(total_cores))
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    parts = -(-parts // cores) * cores
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        **DEFAULT_CONF,
    }
