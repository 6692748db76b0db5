"""Neighbours, running counts and short frames inside a key, safe for hot keys.

A plain window puts a whole key into one task. Here a key is cut into chunks that run as
separate window groups, and the few values a chunk needs from its neighbours travel with
it. Two forms:

* `halo` for rows that carry a dense position (0, 1, 2 ...): the last rows of a chunk are
  copied into the next one. One shuffle, no statistics.
* `adjacent` for rows with any order: keys above `max_rows` rows are found by a count and
  cut at quantiles of that order; one summary row per chunk brings its edge values. With no
  hot key the adaptive planner removes the extra branches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# At most N / HOT_ROWS keys can be hot in N rows, which bounds both broadcast tables below.
HOT_ROWS = 4_000_000
# Sampled rows of a hot key per chunk.
SAMPLES = 64
# Rows per chunk of a dense sequence.
CHUNK_ROWS = 1_000_000


def halo(
    df: DataFrame, keys: Sequence[str], *, position: str = "pos", before: int = 1,
    chunk_rows: int = CHUNK_ROWS,
):
    """Rows plus copies of the `before` rows ahead of each chunk.

    Returns the frame, the window of one chunk, and the predicate that keeps the originals.
    """
    if chunk_rows <= before:
        raise ValueError("chunk_rows must exceed the number of rows looked back")
    own = F.floor(F.col(position) / chunk_rows).cast("int")
    later = F.floor((F.col(position) + before) / chunk_rows).cast("int")
    copies = F.when(own == later, F.array(own)).otherwise(F.array(own, later))
    out = df.withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return out, window, F.col("_chunk") == own


def split_hot_keys(
    df: DataFrame, keys: Sequence[str], order: Column, *, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `_chunk` (0 for ordinary keys) and `_hot`; chunks follow `order`, a value or a struct.

    A hot key is cut at quantiles of the order itself, ties included, taken from about SAMPLES
    rows per chunk. Outliers and equal leading values so leave the chunks of one size.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = sizes.select(*keys, "_n", F.ceil(F.col("_n") / max_rows).alias("_parts"))
    step = F.greatest(F.floor(F.col("_n") / (F.col("_parts") * SAMPLES)), F.lit(1))
    sample = df.select(*keys, order.alias("_order")).join(F.broadcast(hot), list(keys))
    sample = sample.filter(F.pmod(F.xxhash64("_order"), step) == 0)
    # About SAMPLES entries per chunk, and at most N / HOT_ROWS chunks in all.
    sorted_ = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_order")).alias("_s"), F.max("_parts").alias("_parts"))
    picked = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("_parts") - 1),
        lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_parts")).cast("int")),
    )
    cuts = sorted_.select(*keys, picked.alias("_cuts"))
    chunk = F.size(F.filter("_cuts", lambda cut: cut <= order))
    return (
        df.join(F.broadcast(cuts), list(keys), "left")
        .withColumn("_hot", F.col("_cuts").isNotNull())
        .withColumn("_chunk", F.when(F.col("_hot"), chunk).otherwise(0))
        .drop("_cuts")
    )


def adjacent(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    *,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    counted: Column | None = None,
    counts: Mapping[str, Column] = {},
    highest: Mapping[str, Column] = {},
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `previous` / `following` structs of the neighbour rows of the same key, and
    `counted`, the running number of rows (this one included) for which that column holds.
    `counts` names further running numbers, `highest` running maxima."""
    counts = {**counts, **({} if counted is None else {"counted": counted})}
    order = F.struct(*order_by)
    chunked = split_hot_keys(df, keys, order, max_rows=max_rows)
    edges = []
    if previous:
        edges.append(F.max_by(F.struct(*previous), order).alias("_tail"))
    if following:
        edges.append(F.min_by(F.struct(*following), order).alias("_head"))
    edges += [F.count_if(c).alias(f"_run_{n}") for n, c in counts.items()]
    edges += [F.max(c).alias(f"_run_{n}") for n, c in highest.items()]
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    summary = chunked.filter("_hot").groupBy(*keys, "_chunk").agg(*edges)
    carried = [*keys, "_chunk"]
    if previous:
        carried.append(F.lag("_tail").over(by_chunk).alias("_tail"))
    if following:
        carried.append(F.lead("_head").over(by_chunk).alias("_head"))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried += [F.sum(f"_run_{n}").over(earlier).alias(f"_run_{n}") for n in counts]
    carried += [F.max(f"_run_{n}").over(earlier).alias(f"_run_{n}") for n in highest]
    rows = chunked.join(F.broadcast(summary.select(*carried)), [*keys, "_chunk"], "left")

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order_by)
    added = {}
    if previous:
        added["previous"] = F.coalesce(F.lag(F.struct(*previous)).over(inside), F.col("_tail"))
    if following:
        added["following"] = F.coalesce(F.lead(F.struct(*following)).over(inside), F.col("_head"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, column in counts.items():
        added[name] = F.coalesce(F.col(f"_run_{name}"), F.lit(0)) + F.count_if(column).over(upto)
    for name, column in highest.items():
        # The larger of what earlier chunks and this one hold; nulls do not count.
        added[name] = F.greatest(F.col(f"_run_{name}"), F.max(column).over(upto))
    return rows.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def global_rank(
    df: DataFrame, bucket: Column, order_by: Sequence[Column], *, position: Column | None = None,
    max_rows: int = HOT_ROWS, name: str = "rank",
) -> DataFrame:
    """1-based rank over the whole table without gathering it in one task.

    `bucket` must rise with the order and take a bounded number of values; only one count
    per bucket is brought together. Where a bucket can be hot, `position` (a value or struct
    that rises with the order) cuts it further. A null bucket is a bucket of its own.
    """
    rows = df.withColumn("_bucket", bucket)
    if position is None:
        rows = rows.withColumn("_chunk", F.lit(0))
    else:
        rows = split_hot_keys(rows, ["_bucket"], position, max_rows=max_rows)
    counts = rows.groupBy("_bucket", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket", "_chunk").orderBy(*order_by)
    return (
        rows.join(
            F.broadcast(offsets.withColumnsRenamed({"_bucket": "_b", "_chunk": "_c"})),
            F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("_chunk") == F.col("_c")),
        )
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .select(*df.columns, name)
    )
