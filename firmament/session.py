"""Session and scratch-space helpers.

Operators never create sessions; they take DataFrames. These helpers exist for
tests, bench and the driver entry points.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "firmament") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UTC, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage.
    Only when it is unset (local tests) do we create one under /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="firmament-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused directory under the checkpoint root."""
    root = checkpoint_root(spark)
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go once the driver has collected its
    garbage; without a call they stay until it happens to, and add up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cluster_conf(input_bytes: int, executor_cores: int = 4, executor_memory_gb: int = 16) -> dict[str, str]:
    """Session settings for a large cluster, sized from the input volume.

    * Shuffle partitions start at about one per 256 MB of input (at least
      2,000); AQE coalesces small ones and splits skewed ones at run time.
    * File splits of 256 MB keep a scan task well inside executor memory.
    * Skew join handling is on: a key holding a large share of the rows is
      split over several tasks instead of landing in one.
    * The automatic broadcast threshold stays moderate; adaptive execution
      broadcasts a side when its size at run time is below it.
    """
    per_partition = 256 * 1024 * 1024
    partitions = max(2000, int(input_bytes // per_partition))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(per_partition),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(per_partition),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(per_partition),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
        "spark.executor.cores": str(executor_cores),
        "spark.executor.memory": f"{executor_memory_gb}g",
    }
