"""Example packs and the round-robin choice of examples for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstate.schemas import FIELDS

EXAMPLE_COLUMNS = (
    "seq", "interaction_id", "turn_number", "context_module", "human_input", "ai_response",
    "hint", "evidence_spans", "observer_notes",
)


def example_pack(extracts: DataFrame, *, max_examples: int | None = 8) -> DataFrame:
    """First `max_examples` stored rows of each run (None: all), as example columns.

    Extract rows: run_id, seq, texts, `jsv_hint`, `overlay`, `track_metadata`. The rank
    filter is pushed into the map side, so a hot run ships at most `max_examples` rows per
    task.
    """
    if max_examples is not None:
        by_run = Window.partitionBy("run_id").orderBy("seq")
        extracts = extracts.withColumn("_rank", F.row_number().over(by_run)).filter(
            F.col("_rank") <= max_examples
        )
    return extracts.select(
        F.col("run_id").alias("pack_id"),
        "seq", "interaction_id", "turn_number", "context_module", "human_input", "ai_response",
        F.col("jsv_hint").alias("hint"),
        F.coalesce(F.col("overlay.evidence_spans"), F.array()).alias("evidence_spans"),
        F.coalesce(F.col("track_metadata.observer_notes"), F.lit("")).alias("observer_notes"),
    )


def _round_robin(examples: DataFrame, target: list[str], n: int, order: list[str]) -> DataFrame:
    """First n per target: one example of each bucket per round, buckets alphabetical."""
    in_bucket = Window.partitionBy(*target, "_bucket").orderBy(*order)
    over_rounds = Window.partitionBy(*target).orderBy("_round", "_bucket")
    return (
        examples.withColumn("_round", F.row_number().over(in_bucket))
        .filter(F.col("_round") <= n)
        .withColumn("rank", F.row_number().over(over_rounds))
        .filter(F.col("rank") <= n)
    )


def select_examples(targets: DataFrame, examples: DataFrame, *, max_examples: int) -> DataFrame:
    """Attach `examples` (ordered, at most `max_examples`) to each target.

    An example qualifies when its context equals the target's and its interaction differs.
    Targets are never joined with all examples. A pool keeps, per context and holder, the
    first `max_examples` rows of each interaction and then the first 2 x `max_examples` of
    those: enough for every target whichever interaction it excludes. Leaving out rows that
    were not chosen changes nothing, so only interactions inside the choice of their
    context (at most `max_examples` per context) need a choice of their own. Contexts and
    holders are enumerated values; with packs there are as many lists as packs and contexts, so
    how the lists reach the targets is left to Spark's size check.

    Targets with a `pack_id` choose from that pack only; others from all examples, and equal
    `seq` values of several packs are told apart by pack, interaction and turn.
    """
    n = max_examples
    group = ["pack_id", "context_module"] if "pack_id" in targets.columns else ["context_module"]
    order = ["seq", *[c for c in ("pack_id", "interaction_id", "turn_number") if c in examples.columns]]
    ranked = examples.withColumn("_bucket", F.coalesce(F.col("hint.judgment_holder"), F.lit("Unknown")))
    own = Window.partitionBy(*group, "_bucket", "interaction_id").orderBy(*order)
    pooled = Window.partitionBy(*group, "_bucket").orderBy(*order)
    pool = (
        ranked.withColumn("_own", F.row_number().over(own))
        .filter(F.col("_own") <= n)
        .withColumn("_pool", F.row_number().over(pooled))
        .filter(F.col("_pool") <= 2 * n)
        .drop("_own", "_pool")
    )
    chosen = _round_robin(pool, group, n, order)
    example = F.struct("rank", *[c for c in EXAMPLE_COLUMNS if c in examples.columns])
    listed = F.array_sort(F.collect_list(example))
    common = chosen.groupBy(*group).agg(listed.alias("_common"))

    special = chosen.select(*group, F.col("interaction_id").alias("_target")).distinct()
    others = pool.join(special, group).filter(
        F.col("interaction_id") != F.col("_target")
    )
    own_lists = (
        _round_robin(others, [*group, "_target"], n, order)
        .groupBy(*group, "_target")
        .agg(listed.alias("_listed"))
    )
    # A special target without any other example keeps an empty list of its own.
    excluded = special.join(own_lists, [*group, "_target"], "left").select(
        *group, F.col("_target").alias("interaction_id"),
        F.coalesce("_listed", F.array().cast(_type_of(own_lists, "_listed"))).alias("_excluded"),
    )
    found = F.coalesce(
        "_excluded", "_common", F.array().cast(_type_of(own_lists, "_listed"))
    )
    return (
        targets.join(excluded, [*group, "interaction_id"], "left")
        .join(common, group, "left")
        .withColumn("examples", found)
        .withColumn("example_count", F.size("examples"))
        .withColumn("zero_shot_fallback", F.size("examples") == 0)
        .select(*targets.columns, "examples", "example_count", "zero_shot_fallback")
    )


def _type_of(df: DataFrame, column: str):
    return df.schema[column].dataType


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(wrapped, r'(?s)^\{"v":(.*)\}$', "$1")


def _json_object(**members: Column) -> Column:
    parts = [F.concat(F.lit(f'"{n}": '), F.coalesce(v, F.lit("null"))) for n, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def rendered_example(example: Column) -> Column:
    """One example as a JSON line with input and expected output."""
    hint = example["hint"]
    confidence = _json_object(**{f: _json_string(hint["confidence"][f]) for f in FIELDS})
    span = lambda s: F.concat(
        F.lit('{"text": '), _json_string(s["text"]), F.lit(', "category": '),
        _json_string(s["category"]),
        F.when(s["note"].isNotNull(), F.concat(F.lit(', "note": '), _json_string(s["note"])))
        .otherwise(""),
        F.lit("}"),
    )
    spans = F.concat(
        F.lit("["), F.array_join(F.transform(example["evidence_spans"], span), ", "), F.lit("]")
    )
    return _json_object(
        input=_json_object(
            interaction_id=_json_string(example["interaction_id"]),
            turn_number=example["turn_number"].cast("string"),
            context_module=_json_string(example["context_module"]),
            human_input=_json_string(example["human_input"]),
            ai_response=_json_string(example["ai_response"]),
        ),
        output=_json_object(
            **{f: _json_string(hint[f]) for f in FIELDS},
            confidence=confidence,
            evidence_spans=spans,
            observer_notes=_json_string(example["observer_notes"]),
        ),
    )


def fewshot_prompt(pack_id: Column, examples: Column, target_prompt: Column) -> Column:
    return F.concat(
        F.lit("fewshot_pack_id: "), pack_id, F.lit("\nfewshot_examples:\n"),
        F.array_join(F.transform(examples, rendered_example), "\n"),
        F.lit("\n\ntarget_turn:\n"), target_prompt,
    )
