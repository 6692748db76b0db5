"""Deterministic train / validation / test assignment and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hexadecimal digits per level of buckets: a level's counts have at most 16 ** 3 rows for the
# whole table and as many for each of the two buckets that a cut runs through.
PREFIX = 3
CARRIED = ["_start", "_first", "_second"]


def _decided(rows: DataFrame, level: list[str]) -> DataFrame:
    """Rows with `_split` where their bucket lies on one side of both cuts, else null, and
    `_start`, the rows ahead of the bucket."""
    counts = rows.groupBy(*CARRIED, *level).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*CARRIED).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    placed = counts.withColumn("_begin", begin).withColumn("_end", F.col("_begin") + F.col("_n")).select(
        *CARRIED, *level, "_begin",
        F.when(F.col("_end") <= F.col("_first"), "train")
        .when((F.col("_begin") >= F.col("_first")) & (F.col("_end") <= F.col("_second")), "validation")
        .when(F.col("_begin") >= F.col("_second"), "test").alias("_split"),
    )
    # Bounded by PREFIX.
    return rows.join(F.broadcast(placed), [*CARRIED, *level]).drop("_start").withColumnRenamed("_begin", "_start")


def _cuts(rows: DataFrame, train: float, validation: float) -> DataFrame:
    """Rows with both cuts, taken from the bucket counts, and nothing ahead of them yet."""
    total = F.sum("_n").over(Window.partitionBy(F.lit(0))).cast("double")
    first = F.floor(total * train)
    buckets = rows.groupBy("_b1").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b1", F.lit(0).cast("bigint").alias("_start"), first.alias("_first"), (first + F.floor(total * validation)).alias("_second")
    )
    return rows.join(F.broadcast(buckets), "_b1")


def assign_splits(
    items: DataFrame, *, seed: int, train: float = 0.6, validation: float = 0.2,
    key: str = "interaction_id",
) -> DataFrame:
    """Shuffle by a seeded hash, then cut at floor(n x train) and floor(n x validation).

    Buckets of hash prefixes are counted, and whole buckets on one side of a cut are decided by
    the counts. Rows are ranked only in the sub-bucket that a cut runs through, so no wide row
    of any other is shuffled. A null key counts as an empty text and sorts first among equals.
    """
    if train < 0 or validation < 0 or train + validation > 1:
        raise ValueError("split ratios must be non-negative and sum to at most 1")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    hashed = F.md5(text.cast("binary"))
    rows = items.withColumn("_h", hashed).withColumn("_b1", F.substring("_h", 1, PREFIX))
    rows = _decided(_cuts(rows, train, validation), ["_b1"])
    closed, opened = rows.filter(F.col("_split").isNotNull()), rows.filter(F.col("_split").isNull()).drop("_split")
    opened = _decided(opened.withColumn("_b2", F.substring("_h", PREFIX + 1, PREFIX)), ["_b1", "_b2"])
    inside = Window.partitionBy("_b1", "_b2").orderBy("_h", key)
    ranked = opened.filter(F.col("_split").isNull()).withColumn("_rank", F.col("_start") + F.row_number().over(inside))
    ranked = ranked.withColumn(
        "_split",
        F.when(F.col("_rank") <= F.col("_first"), "train").when(F.col("_rank") <= F.col("_second"), "validation").otherwise("test"),
    )
    parts = [closed, opened.filter(F.col("_split").isNotNull()), ranked]
    first, *others = [p.select(*items.columns, F.col("_split").alias("split")) for p in parts]
    for other in others:
        first = first.unionByName(other)
    return first


def split_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("split").agg(F.count(F.lit(1)).alias("item_count"))
