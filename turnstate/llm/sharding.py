"""Sharding by extendible hashing: a directory over hash-prefix bits, split only where needed.

A shard is a prefix of the hash. The directory starts as one bucket of depth zero; a bucket
over the byte limit is split on its next bit, and a bucket that fits is left as it is. The
sizes of all prefixes down to a working depth come from one aggregation; only buckets that
are still too large at that depth are looked at again, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

BITS = 60  # fifteen hexadecimal digits of the digest: fits a signed long
MARGIN = 5  # bits beyond those that an even split of the bytes would need


def hash_bits(*columns: str) -> Column:
    """The first 60 bits of an MD5 over the columns; a null counts as a value of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\u001f", *parts).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _sizes(rows: DataFrame, base: int, depth: int) -> DataFrame:
    """(level, prefix, bytes, rows) for every used prefix of `base` to `depth` bits."""
    cells = rows.groupBy(F.shiftright("bits", BITS - depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows")
    )
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(depth))))
    return levels.groupBy("level", F.expr(f"shiftright(cell, {depth} - level)").alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )


def directories(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """(depth, directory) per round for rows of (bits, bytes).

    A directory maps each used cell, the top `depth` bits, to its shard: (cell, level, prefix,
    parts). `parts` is above one only where all bits are spent, that is among equal rows.
    """
    found: list[tuple[int, DataFrame]] = []
    base, largest = 0, rows.agg(F.sum("bytes")).first()[0] or 0
    while True:
        depth = min(BITS, base + MARGIN + max(1, math.ceil(math.log2(max(largest, 1) / limit)) if largest > limit else 1))
        sizes = stored(_sizes(rows, base, depth), "shard-sizes")
        over, fits = sizes.filter(F.col("bytes") > limit), sizes.filter(F.col("bytes") <= limit)
        parent = over.select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
        shards = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parent, ["level", "parent"], "left_semi")
        if base == 0:
            shards = shards.select("level", "prefix").union(fits.filter("level = 0").select("level", "prefix"))
        width = f"shiftleft(1L, {depth} - level)"
        cells = shards.select(
            "level", "prefix", F.explode(F.expr(f"sequence(prefix * {width}, (prefix + 1) * {width} - 1)")).alias("cell")
        ).withColumn("parts", F.lit(1).cast("long"))
        # Only cells that hold rows: an empty corner of the directory needs no entry.
        used = sizes.filter(F.col("level") == depth).select(F.col("prefix").alias("cell"))
        cells = cells.join(used, "cell", "left_semi")
        opened = over.filter(F.col("level") == depth)
        if depth == BITS:
            whole = opened.select(
                "level", "prefix", F.col("prefix").alias("cell"),
                F.when(F.col("rows") > 1, F.ceil(F.col("bytes") * 2 / limit)).otherwise(1).cast("long").alias("parts"),
            )
            found.append((depth, stored(cells.unionByName(whole), "shard-directory")))
            return found
        found.append((depth, stored(cells, "shard-directory")))
        left, largest = opened.agg(F.count("*"), F.max("bytes")).first()
        if not left:
            return found
        rows = rows.withColumn("cell", F.shiftright("bits", BITS - depth)).join(
            opened.select(F.col("prefix").alias("cell")), "cell", "left_semi"
        ).drop("cell")
        base = depth


def assign(docs: DataFrame, limit: int, keys: tuple[str, ...] = ("doc_id", "text"), text: str = "text") -> DataFrame:
    """The rows of `docs` with struct column `shard`: (name, level, bytes).

    `name` is the shard's hash prefix as binary digits, empty where one shard holds all.
    Each shard holds at most `limit` bytes of UTF-8 text; null and empty texts have none. A row
    that is larger than the limit alone is a shard of its own. Equal rows share all bits: if they
    are over the limit together, they are dealt into numbered parts (`name#part`). Null keys are
    values like any other. An existing column `shard` is replaced.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c != "shard"]
    # Everything of the input stays inside `row`, so no name of it can clash with one used here.
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    result = docs.select(row, hash_bits(*keys).alias("bits"), size.alias("bytes"), F.spark_partition_id().alias("source"))
    rounds = directories(docs.select(hash_bits(*keys).alias("bits"), size.alias("bytes")), limit)
    for depth, directory in rounds:
        entry = directory.select(F.col("cell").alias("own"), F.struct("level", "prefix", "parts").alias(f"entry{depth}"))
        result = result.withColumn("own", F.shiftright("bits", BITS - depth)).join(entry, "own", "left")
    entry = F.coalesce(*[F.col(f"entry{depth}") for depth, _ in rounds])
    result = result.select("row", "bits", "bytes", "source", entry.alias("e")).withColumn("part", F.lit(None).cast("string"))
    if rounds[-1][0] == BITS:
        # Equal rows over the limit are counted per input partition, which a rerun does not change.
        equal = Window.partitionBy("bits", "source")
        fit = F.greatest(F.floor(F.lit(limit) / F.max("bytes").over(equal)), F.lit(1))
        part = F.floor((F.row_number().over(equal.orderBy("bytes")) - 1) / fit)
        dealt = result.filter("e.parts > 1").withColumn("part", F.concat_ws(".", "source", part))
        result = result.filter("e.parts <= 1").unionByName(dealt)
    prefix = F.when(F.col("e.level") > 0, F.expr("lpad(bin(e.prefix), cast(e.level as int), '0')")).otherwise("")
    name = F.concat_ws("#", prefix, "part")
    shard = F.struct(name.alias("name"), F.col("e.level").cast("long").alias("level"), "bytes").alias("shard")
    return result.select("row.*", shard)


def write_shards(docs: DataFrame, path: str, limit: int, **options) -> None:
    """Write one folder per shard; a shard fits one task, so it is one file."""
    rows = assign(docs, limit, **options).select("*", F.col("shard.name").alias("shard_name"))
    rows.repartition("shard_name").drop("shard").write.partitionBy("shard_name").parquet(path)
