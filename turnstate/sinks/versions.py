"""Tables that become visible together: a manifest written last names the files of a version.

A writer puts its rows into folders that nobody reads yet and then commits one manifest, a single
file that appears as a whole. Readers take the newest manifest and open only the folders it names,
so they see the state before a commit or after it, never half of one. What a failed writer leaves
behind is named by no manifest. One writer works on a root at a time.

A table may be divided into buckets by a hash of its key. A version then names the segments of
each bucket, and a reader that needs a few keys opens the segments of their buckets only.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version bigint, parts array<struct<name string, path string, bucket int>>, notes map<string, string>"
BUCKETS = 256
SEGMENTS = 8  # segments of a bucket from which the next write merges them into one


@dataclass(frozen=True)
class Part:
    """A folder of a table: all of one write, or one bucket of it."""

    name: str
    path: str
    bucket: int | None = None


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    notes: Mapping[str, str] = field(default_factory=dict)

    def of(self, name: str) -> list[Part]:
        return [p for p in self.parts if p.name == name]

    def crowded(self, name: str, buckets: Iterable[int], segments: int) -> list[int]:
        """Those of `buckets` that have at least this many segments."""
        counts: dict[int, int] = {}
        for part in self.of(name):
            counts[part.bucket] = counts.get(part.bucket, 0) + 1
        return [b for b in buckets if counts.get(b, 0) >= segments]

    def without(self, name: str, buckets: Iterable[int] | None = None) -> list[Part]:
        """All parts but those of a table, or of some of its buckets."""
        gone = None if buckets is None else set(buckets)
        return [p for p in self.parts if p.name != name or (gone is not None and p.bucket not in gone)]


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def buckets_in(df: DataFrame, bucket: Column) -> list[int]:
    """The buckets that rows fall into: at most as many values as there are buckets."""
    return sorted(r[0] for r in df.select(bucket.alias("b")).distinct().collect())


class Versions:
    """The versions of the tables under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> Version:
        """The newest committed version; number 0 before the first."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/versions")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return Version()
        number = F.regexp_extract("path", r"/v(\d{12})/[^/]+\.json$", 1)
        newest = files.select("path", number.alias("n")).filter("n <> ''").agg(F.max(F.struct("n", "path")).alias("m")).first()["m"]
        if newest is None:
            return Version()
        row = self.spark.read.schema(MANIFEST).json(newest["path"]).first()
        return Version(row["version"], tuple(Part(*p) for p in row["parts"]), dict(row["notes"] or {}))

    def add(self, df: DataFrame, name: str, bucket: Column | None = None) -> list[Part]:
        """Write rows to a new folder of a table; they show once a commit names the returned parts."""
        folder = f"{self.root}/{name}/{os.urandom(8).hex()}"
        if bucket is None:
            df.write.parquet(folder)
            return [Part(name, folder)]
        # Rebalancing keeps a bucket in one file where it is small and splits it where it is not.
        df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        schema = StructType(df.schema.fields).add("_bucket", "integer")
        found = self.spark.read.schema(schema).parquet(folder).select("_bucket").distinct().collect()
        return [Part(name, f"{folder}/_bucket={r[0]}", r[0]) for r in found]

    def commit(self, base: Version, parts: Iterable[Part], **notes: object) -> Version:
        """Make `parts` the version after `base`; earlier notes stay where no new ones replace them."""
        version = Version(base.number + 1, tuple(parts), {**base.notes, **{k: str(v) for k, v in notes.items()}})
        row = (version.number, [(p.name, p.path, p.bucket) for p in version.parts], dict(version.notes))
        # An attempt that failed here may have left an empty folder of the same number.
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/versions/v{version.number:012d}")
        return version

    def read(self, name: str, schema: StructType | str, *, at: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, in the newest version or in `at`."""
        wanted = None if buckets is None else set(buckets)
        parts = (at or self.current()).of(name)
        paths = [p.path for p in parts if wanted is None or p.bucket in wanted]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], **notes: object) -> Version:
    """Write several tables and make them visible at once, replacing those of the version before."""
    store = Versions(spark, root)
    base = store.current()
    parts = [part for name, df in tables.items() for part in store.add(df, name)]
    return store.commit(base, [*[p for p in base.parts if p.name not in tables], *parts], **notes)
