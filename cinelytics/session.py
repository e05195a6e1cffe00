"""Session helpers: a local session for tests/bench, UTC pinning, scratch space.

Library code never builds its own session; callers pass one in.  ``scratch_path``
hands out folders below the cluster's shared ``spark.checkpoint.dir`` (set a
local one only when the session has none, as in tests), so anything written for
lineage cutting, streaming checkpoints or sink round trips survives the loss of
an executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf keys of this library (read from the session, with defaults).
BROADCAST_MAX_ROWS_KEY = "cinelytics.join.broadcastMaxRows"
BROADCAST_MAX_BYTES_KEY = "cinelytics.join.broadcastMaxBytes"
MAX_SHUFFLE_PARTITIONS = 200_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cinelytics") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: Parquet timestamps are read as TIMESTAMP_NTZ and
    every epoch conversion must mean UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cinelytics-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark)
    return os.path.join(root, "cinelytics", f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to Parquet below the shared checkpoint root: what is read several times
    runs its joins once, in packed columns (a checkpoint holds whole unpacked rows)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_unused(spark: SparkSession) -> None:
    """Spark removes the shuffle files and cached blocks of frames that nothing refers to only when the driver
    collects its garbage, which a driver with room to spare does seldom: ask for it after a large step."""
    spark.sparkContext._jvm.System.gc()


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value else default


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized for a job over ``input_bytes`` on ``total_cores``.

    Scan splits and shuffle partitions both aim at ``target_partition_bytes``
    (so a task's working set fits in executor memory and spills rarely), with
    at least two waves of tasks per core and at most ``MAX_SHUFFLE_PARTITIONS``
    (map x reduce shuffle blocks grow quadratically beyond that); AQE coalesces
    the small shuffles and splits skewed ones at run time.  Example: 100 TB on
    8,000 cores gives 200k shuffle partitions of about 500 MB of input each."""
    partitions = min(MAX_SHUFFLE_PARTITIONS,
                     max(2 * total_cores, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.session.timeZone": "UTC",
        BROADCAST_MAX_ROWS_KEY: str(2_000_000),
    }
