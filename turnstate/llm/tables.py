"""Reading the given tables and writing intermediate ones to the shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from turnstate.session import CHECKPOINT_KEY, checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session without the setting gets its own."""
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    unset = spark.conf.get(CHECKPOINT_KEY, None) is None
    fallback = tempfile.mkdtemp(prefix="turnstate-") if unset and local else None
    return f"{checkpoint_root(spark, fallback)}/{name}-{os.urandom(6).hex()}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: the lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
