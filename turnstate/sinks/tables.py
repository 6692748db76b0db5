"""Outputs: JSON at the edges, Parquet tables inside, publication only when complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstate.operators.bayes import Model, Scoring
from turnstate.operators.bayes import frequent as bayes_frequent
from turnstate.sinks.versions import Part, Versions
from turnstate.sources.documents import MODEL_VERSION

# Manifests of published tables and runs; Spark leaves such folders out when it reads the table.
COMMITS = "_commits"


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; null members are left out."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, *, key: str) -> None:
    """One JSON object per row under a folder per key value; commits atomically per write.

    Only touched keys are replaced.
    """
    (
        df.withColumn("_key", F.col(key))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_key")
        .json(path)
    )


def write_table(df: DataFrame, path: str, *, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Replace the partitions present in `df` and hand back the stored table."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)
    # The known schema also serves a table whose partitions are all empty.
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if seen.get["rows"] and stored.isEmpty():
        raise RuntimeError(f"{path} was written but cannot be read: is the folder shared by all executors?")
    return stored


def append_log(df: DataFrame, path: str) -> None:
    """Upserts are appended; `operators.catalog.latest` reads the current rows."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a log so far, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_children(items: DataFrame, path: str) -> None:
    """Replace all items of the datasets present in `items` and leave other datasets."""
    write_table(items, path, partitions=("dataset_id",))


def write_errors(errors: DataFrame, path: str) -> None:
    """Quarantine rows with the error and every tried response."""
    errors.write.mode("append").parquet(path)


def write_model(model: Model, path: str, *, tokens: bool = True) -> None:
    """The tables of a model; without `tokens`, its token table is there already."""
    write_table(model.classes.withColumn("version", F.lit(MODEL_VERSION)), f"{path}/classes")
    if tokens:
        write_table(model.tokens, f"{path}/tokens")
    write_table(model.vocabulary, f"{path}/vocabulary")


def write_scoring(scoring: Scoring, path: str) -> Scoring:
    """Store the scoring tables and hand back the stored ones, whose sizes Spark knows."""
    weights = write_table(scoring.weights, f"{path}/weights")
    return Scoring(
        weights,
        bayes_frequent(weights),
        write_table(scoring.constants, f"{path}/constants"),
        scoring.classes,
    )


def publish_if_complete(
    spark: SparkSession, items: DataFrame, *, staging: str, target_path: str, target_count: int
) -> int:
    """Write to staging, count there, and publish only a complete dataset.

    Each publication is a new folder `version=n` beside the earlier ones, and a manifest written
    after it names that folder. `published` opens what the newest manifest names, so a publication
    that fails at any point shows nothing and takes nothing away. Raises when items are missing;
    the staged items stay for the next attempt.
    """
    staged = write_table(items, staging)
    accepted = staged.count()
    if accepted != target_count:
        raise RuntimeError(
            f"dataset generation incomplete: accepted={accepted}, target={target_count}"
        )
    before = read_log(spark, target_path)
    newest = (None if before is None else before.agg(F.max("version")).first()[0]) or 0
    staged.withColumn("version", F.lit(newest + 1)).write.mode("append").partitionBy("version").parquet(target_path)
    store = Versions(spark, f"{target_path}/{COMMITS}")
    store.commit(store.current(), [Part("items", f"{target_path}/version={newest + 1}")], rows=accepted)
    return accepted


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed publication; an error before the first."""
    current = Versions(spark, f"{path}/{COMMITS}").current()
    if not current.parts:
        raise LookupError(f"nothing is published under {path}")
    return spark.read.parquet(current.parts[0].path)


def run_name(run_id: str) -> str:
    """The name that a run's parts have in the manifest of its folder."""
    return f"run:{run_id}"


def withdraw_run(spark: SparkSession, out: str, run_id: str) -> None:
    """Take a run out of the manifest before its tables are written again."""
    store = Versions(spark, f"{out}/{COMMITS}")
    at = store.current()
    if at.of(run_name(run_id)):
        store.commit(at, at.without(run_name(run_id)))


def commit_run(spark: SparkSession, out: str, run_id: str, names: Sequence[str]) -> None:
    """Make the tables of a run visible to `committed_run`, all at once."""
    store = Versions(spark, f"{out}/{COMMITS}")
    at = store.current()
    parts = [Part(run_name(run_id), f"{out}/{name}") for name in names]
    store.commit(at, [*at.without(run_name(run_id)), *parts])


def committed_run(spark: SparkSession, out: str, run_id: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A table of a run, which must be committed: a run that is being written is not read."""
    parts = Versions(spark, f"{out}/{COMMITS}").current().of(run_name(run_id))
    if f"{out}/{name}" not in [p.path for p in parts]:
        raise LookupError(f"run {run_id} has no committed table {name} under {out}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{out}/{name}").filter(F.col("run_id") == run_id)


def preview(items: DataFrame, turns: DataFrame, *, max_items: int = 6) -> DataFrame:
    """First items in manifest order with their turns nested.

    Turns are nested only for the few previewed items, and in parts of bounded length.
    """
    first = items.orderBy("seq").limit(max_items)
    members = ["pos", "turn_number", "human_input", "ai_response"]
    extra = ["hint"] if "hint" in turns.columns else []
    nested = (
        turns.join(F.broadcast(first.select("interaction_id")), "interaction_id", "left_semi")
        .withColumn("part", F.floor(F.col("pos") / 10_000).cast("int"))
        .groupBy("interaction_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*members, *extra))).alias("turns"))
    )
    return first.join(nested, "interaction_id", "left")
