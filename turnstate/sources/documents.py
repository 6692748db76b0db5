"""JSON and Parquet inputs with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.operators.bayes import Model
from turnstate.schemas import (
    DATASET_MANIFEST,
    EXAMPLE_PACK,
    EXTRACT,
    FIELDS,
    INTERACTION,
    RUN_SUMMARY,
    SCENARIO_PACK,
)

# Fixed value: version of the model artifact this code reads and writes.
MODEL_VERSION = "naive-bayes-tables-v1"


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """A folder of documents, one JSON object per file, in a single scan.

    Columns: the interaction, its text `raw`, `source_path`, and `malformed`.
    """
    files = spark.read.text(path, wholetext=True)
    schema = T.StructType([*INTERACTION.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col("value"), schema, {"columnNameOfCorruptRecord": "_bad"})
    return files.select(
        parsed.alias("d"), F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_path")
    ).select(
        "d.interaction_id", "d.context_module", "d.participants", "d.turns", "raw", "source_path",
        F.col("d._bad").isNotNull().alias("malformed"),
    )


def read_interaction_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same documents one per line, which scales past many small files."""
    return spark.read.schema(INTERACTION).option("mode", "FAILFAST").json(path)


def flatten_turns(interactions: DataFrame) -> DataFrame:
    """One row per turn; the order of the array is the sequence, not the turn number."""
    return interactions.select(
        "interaction_id", "context_module", F.posexplode("turns").alias("pos", "t")
    ).select(
        "interaction_id",
        F.coalesce("context_module", F.lit("general")).alias("context_module"),
        "pos",
        F.col("t.turn_number").alias("turn_number"),
        F.coalesce("t.human_input", F.lit("")).alias("human_input"),
        F.coalesce("t.ai_response", F.lit("")).alias("ai_response"),
        F.col("t.timestamp").alias("turn_time"),
        F.col("t.meta.timestamp").alias("meta_time"),
        F.col("t.meta.jsv_hint").alias("hint"),
    )


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """Stored label lines; blank lines are skipped and a malformed line fails the job."""
    return spark.read.schema(EXTRACT).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Dataset items in manifest order."""
    doc = spark.read.schema(DATASET_MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return doc.select("dataset_id", F.posexplode("items").alias("seq", "i")).select(
        "dataset_id", "seq", "i.*"
    ).withColumn("slot_values", F.coalesce("slot_values", empty))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(SCENARIO_PACK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("scenario_pack_id", F.posexplode("scenarios").alias("seq", "s")).select(
        "scenario_pack_id", "seq", "s.*"
    )


def scenario_templates(scenarios: DataFrame) -> DataFrame:
    """One row per turn template, from blueprints where a scenario has them."""
    plain = F.array(
        F.struct(F.lit(None).cast("string").alias("blueprint_id"), F.col("turn_templates").alias("turn_templates"))
    )
    groups = F.when(F.coalesce(F.size("blueprints"), F.lit(0)) > 0, F.col("blueprints")).otherwise(plain)
    return scenarios.select("scenario_id", F.explode(groups).alias("b")).select(
        "scenario_id", "b.blueprint_id", F.posexplode("b.turn_templates").alias("position", "t")
    ).select("scenario_id", "blueprint_id", "position", "t.*")


def read_example_pack(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(EXAMPLE_PACK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.col("source_run_id").alias("pack_id"), F.posexplode("examples").alias("seq", "e")).select(
        "pack_id", "seq",
        "e.interaction_id", "e.turn_number", "e.context_module", "e.human_input", "e.ai_response",
        F.col("e.jsv_hint").alias("hint"), "e.evidence_spans", "e.observer_notes",
    )


def read_run_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of run summaries; see `completed_items`."""
    doc = spark.read.schema(RUN_SUMMARY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("dataset_run_id", "dataset_id", "track_name", F.posexplode("items").alias("seq", "i")).select(
        "dataset_run_id", "dataset_id", "track_name", "seq", "i.*"
    )


def completed_items(items: DataFrame, group: list[str]) -> DataFrame:
    """Completed items, the last one of each interaction kept."""
    rest = [c for c in items.columns if c not in (*group, "interaction_id")]
    return (
        items.filter(F.col("status") == "completed")
        .groupBy(*group, "interaction_id")
        .agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
        .select(*group, "interaction_id", "_last.*")
    )


def read_model(spark: SparkSession, path: str, *, fields: Sequence[str] = FIELDS) -> Model:
    """Load model tables; reading them fails on another version or a missing field."""
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    wanted = F.array(*[F.lit(f) for f in fields])
    check = table("classes").agg(
        F.bool_and(F.col("version") == MODEL_VERSION).alias("_same"),
        F.array_except(wanted, F.collect_set("field")).alias("_missing"),
    )
    # A one-row check joined on a constant key: scoring cannot run without it.
    guard = check.select(
        F.when(~F.coalesce(F.col("_same"), F.lit(False)), F.raise_error(F.lit("unexpected model version")))
        .when(F.size("_missing") > 0, F.raise_error(F.concat(F.lit("model lacks fields: "), F.array_join("_missing", ", "))))
        .otherwise(F.lit(MODEL_VERSION)).cast("string")
        .alias("version")
    )
    classes = table("classes").join(F.broadcast(guard), "version").drop("version")
    return Model(classes, table("tokens"), table("vocabulary"))
