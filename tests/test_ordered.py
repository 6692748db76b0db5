"""Split forms must equal a plain window over the whole key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstate.operators.catalog import run_list_position
from turnstate.operators.ordered import adjacent, global_rank, halo, split_hot_keys
from turnstate.sources.chat import turns_from_chat


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; order values have gaps and repeats."""
    n = F.col("id")
    return spark.range(600).select(
        F.when(n % 5 == 0, n % 7).otherwise(99).alias("k"),
        F.floor(F.pow(n, 1.5) / 3).cast("long").alias("at"), n.alias("tie"),
        F.when(F.hash(n) % 2 == 0, "user").otherwise("assistant").alias("role"),
    )


@pytest.mark.parametrize("max_rows", [10, 37, 10_000])
def test_adjacent_equals_window(skewed, rows, max_rows):
    got = adjacent(
        skewed, ["k"], ["at", "tie"], previous=["tie", "role"], following=["tie"],
        counted=F.col("role") == "user", max_rows=max_rows,
    ).select("k", "tie", "previous.tie", "previous.role", "following.tie", "counted")
    w = Window.partitionBy("k").orderBy("at", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "k", "tie", F.lag("tie").over(w), F.lag("role").over(w), F.lead("tie").over(w),
        F.count_if(F.col("role") == "user").over(upto),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chunk", [6, 7, 50, 1000])
def test_halo_equals_window(spark, rows, chunk):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("int").alias("pos"))
    copies, window, own = halo(df, ["k"], before=5, chunk_rows=chunk)
    got = copies.select(
        "k", "pos", F.collect_list("pos").over(window.rowsBetween(-5, -1)).alias("seen"), own.alias("own")
    ).filter("own").drop("own")
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(-5, -1)
    assert rows(got) == rows(df.select("k", "pos", F.collect_list("pos").over(w)))


def test_halo_needs_room():
    with pytest.raises(ValueError):
        halo(None, ["k"], before=5, chunk_rows=5)


def test_global_rank_equals_window(skewed, rows):
    h = F.md5(F.col("tie").cast("string").cast("binary"))
    df = skewed.select("tie", h.alias("h"))
    got = global_rank(df, F.substring("h", 1, 1), [F.col("h")])
    want = df.withColumn("rank", F.row_number().over(Window.orderBy("h")))
    assert rows(got.select("tie", "rank")) == rows(want.select("tie", "rank"))


@pytest.mark.parametrize("max_rows", [3, 10_000])
def test_global_rank_cuts_hot_buckets(skewed, rows, max_rows):
    df = skewed.select("at", "tie")
    got = global_rank(df, F.floor(F.col("at") / 5000), [F.col("at"), F.col("tie")], position=F.col("at"), max_rows=max_rows)
    want = df.withColumn("rank", F.row_number().over(Window.orderBy("at", "tie")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_turns_from_chat(spark, rows, max_rows):
    log = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "c"),
         (1, 7, "user", "d"), (1, 8, "assistant", None), (2, 0, "assistant", "x"), (2, 1, "user", None)],
        "conv_id int, turn int, role string, text string",
    )
    got = turns_from_chat(log, max_rows=max_rows)
    assert rows(got) == [(1, 0, 0, "a", "b"), (1, 1, 1, "c", ""), (1, 2, 2, "d", ""), (2, 0, 0, "", "")]


@pytest.mark.parametrize("outlier", [10**9, 0])
def test_hot_keys_are_cut_evenly(spark, outlier):
    """Neither an outlier nor equal leading values put a hot key into one chunk."""
    df = spark.range(1000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, outlier).otherwise(5).alias("at"), F.col("id").alias("tie"))
    chunks = split_hot_keys(df, ["k"], F.struct("at", "tie"), max_rows=100).groupBy("_chunk").count().collect()
    assert len(chunks) >= 8 and max(r["count"] for r in chunks) < 300


def test_equal_run_clocks_are_ranked_in_chunks(spark, rows):
    runs = spark.range(300).select(F.lit("2026-01-01T00:00:00Z").alias("updated_at"), F.format_string("r-%03d", "id").alias("run_id"))
    got = run_list_position(runs)
    assert rows(got.select("run_id", "position")) == [(f"r-{k:03d}", k + 1) for k in range(300)]
