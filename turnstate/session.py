"""Session settings: adaptive execution, UTC, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Read from the session; a local default is set only where the key is absent.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "turnstate", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints; `fallback` serves tests that set none."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or fallback
    if not root:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the shared folder of the session.

    Only a local session may do without the setting: its driver and executors are one machine.
    """
    unset = spark.conf.get(CHECKPOINT_KEY, None) is None and spark.sparkContext.master.startswith("local")
    unset = unset and not spark.sparkContext.master.startswith("local-cluster")
    fallback = tempfile.mkdtemp(prefix="turnstate-") if unset else None
    return f"{checkpoint_root(spark, fallback)}/{name}-{os.urandom(6).hex()}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new shared folder and read back: the plan and its lineage end here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_for(input_bytes: int, *, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for an input size: enough shuffle partitions to keep each one in memory.

    Adaptive execution merges the ones that turn out small.
    """
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }
