"""Template datasets: items, choices, filled texts, and generation progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.functions.text import stable_index
from turnstate.schemas import CONTEXTS

# Samples made by one task step; more samples of a scenario spread over further tasks.
BLOCK = 10_000


def plan_items(scenarios: DataFrame, *, dataset_name: str, count: int, seed: int) -> DataFrame:
    """Every scenario times sample index, with ids. Large counts spread in blocks."""
    if count < 1:
        raise ValueError("count_per_scenario must be at least 1")
    blocks = (count - 1) // BLOCK
    rows = scenarios.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    # Scenarios are few and each stands for much work: spread them before they multiply.
    rows = rows.repartition("scenario_id", "_block")
    last = F.least((F.col("_block") + 1) * BLOCK, F.lit(count)) - 1
    rows = rows.withColumn("sample_index", F.explode(F.sequence(F.col("_block") * BLOCK, last)))
    digits = F.col("sample_index").cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))
    interaction = F.concat_ws("-", F.lit(dataset_name), "scenario_id", number)
    return rows.drop("_block").select(
        "*",
        F.concat_ws(":", "scenario_id", number).alias("item_id"),
        interaction.alias("interaction_id"),
        F.concat(F.lit("interactions/"), interaction, F.lit(".json")).alias("relative_path"),
        F.concat_ws(":", F.lit(str(seed)), "scenario_id", F.col("sample_index").cast("string")).alias("choice_key"),
    )


def is_accepted() -> Column:
    """Accepted with a payload; an accepted row without one is tried again."""
    return F.coalesce((F.col("status") == "accepted") & (F.col("item_payload") != ""), F.lit(False))


def latest_attempts(log: DataFrame) -> DataFrame:
    """The last attempt of every item."""
    rest = [c for c in log.columns if c not in ("item_id", "attempt_count")]
    order = F.struct("attempt_count", *[c for c in ("status", "item_payload") if c in rest])
    last = F.max_by(F.struct("attempt_count", *rest), order)
    return log.groupBy("item_id").agg(last.alias("_last")).select("item_id", "_last.*").select(*log.columns)


def pending_items(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Items not accepted before, with the number of the attempt they are about to make."""
    known = existing.select(
        "item_id", is_accepted().alias("_done"), F.col("attempt_count").alias("_tried")
    )
    return (
        plan.join(known, "item_id", "left")
        .filter(~F.coalesce("_done", F.lit(False)))
        .withColumn("attempt_count", F.coalesce("_tried", F.lit(0)) + 1)
        .drop("_done", "_tried")
    )


def _choice(purpose: Column | str, size: Column) -> Column:
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    return stable_index(F.concat_ws("|", "choice_key", purpose), size)


def _pieces(text: Column) -> Column:
    """Template cut before `{` and after `}`; doubled braces stand for single ones."""
    guarded = F.replace(F.replace(text, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    return F.split(guarded, r"(?=\{)|(?<=\})")


def _is_slot(piece: Column) -> Column:
    return F.startswith(piece, F.lit("{")) & F.endswith(piece, F.lit("}"))


def _slot(piece: Column, slots: Column) -> Column:
    return F.try_element_at(slots, F.substr(piece, F.lit(2), F.length(piece) - 2))


def fill_template(text: Column, slots: Column) -> Column:
    """Replace each `{name}` once; a value is never expanded again."""
    filled = F.transform(
        _pieces(text),
        lambda p: F.when(_is_slot(p), F.coalesce(_slot(p, slots), p)).otherwise(
            F.translate(p, "\u0001\u0002", "{}")
        ),
    )
    return F.when(text.isNotNull(), F.array_join(filled, ""))


def has_unknown_slot(text: Column, slots: Column) -> Column:
    return F.coalesce(
        F.exists(_pieces(text), lambda p: _is_slot(p) & _slot(p, slots).isNull()), F.lit(False)
    )


def _variant(turn: Column, field: str, index: Column) -> tuple[Column, Column]:
    options = turn[f"{field}_options"]
    size = F.coalesce(F.size(options), F.lit(0))
    chosen = _choice(F.concat_ws(":", F.lit(field), index.cast("string")), F.greatest(size, F.lit(1)))
    picked = F.when(size > 0, F.get(options, chosen)).otherwise(turn[field])
    return picked, F.when(size > 0, chosen)


def materialise(items: DataFrame) -> DataFrame:
    """Choose slots, blueprint and variants per item and fill its turns.

    Every choice is a hash of the item's own key and the purpose of the choice, so skipping
    accepted items leaves the others unchanged.
    """
    slots = F.map_from_entries(
        F.transform(
            F.map_entries("slot_options"),
            lambda e: F.struct(
                e["key"],
                F.get(e["value"], _choice(F.concat(F.lit("slot:"), e["key"]), F.greatest(F.size(e["value"]), F.lit(1)))),
            ),
        )
    )
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    has_blueprints = F.coalesce(F.size("blueprints"), F.lit(0)) > 0
    blueprint = F.get("blueprints", _choice("blueprint", F.greatest(F.size("blueprints"), F.lit(1))))
    rows = items.withColumn("slot_values", F.coalesce(slots, empty)).withColumn(
        "_blueprint", F.when(has_blueprints, blueprint)
    )
    rows = rows.withColumn(
        "_templates",
        F.when(has_blueprints, F.col("_blueprint.turn_templates")).otherwise(F.col("turn_templates")),
    )

    def picked(turn: Column, index: Column) -> Column:
        human, human_index = _variant(turn, "human_input", index)
        reply, reply_index = _variant(turn, "ai_response", index)
        return F.struct(
            turn["turn_number"].alias("turn_number"),
            human.alias("human_input"),
            reply.alias("ai_response"),
            turn["meta"].alias("meta"),
            human_index.alias("human_input_variant_index"),
            reply_index.alias("ai_response_variant_index"),
        )

    rows = rows.withColumn("_picked", F.transform("_templates", picked))
    unknown = F.exists(
        "_picked",
        lambda t: has_unknown_slot(t["human_input"], F.col("slot_values"))
        | has_unknown_slot(t["ai_response"], F.col("slot_values")),
    )
    turns = F.transform(
        "_picked",
        lambda t: F.struct(
            t["turn_number"].alias("turn_number"),
            fill_template(t["human_input"], F.col("slot_values")).alias("human_input"),
            fill_template(t["ai_response"], F.col("slot_values")).alias("ai_response"),
            t["meta"].alias("meta"),
        ),
    )
    variants = F.transform(
        "_picked",
        lambda t: F.struct(
            t["turn_number"].alias("turn_number"),
            t["human_input_variant_index"].alias("human_input_variant_index"),
            t["ai_response_variant_index"].alias("ai_response_variant_index"),
        ),
    )
    missing_template = F.coalesce(F.size("_templates"), F.lit(0)) < 1
    return rows.select(
        *[c for c in ("item_id", "interaction_id", "relative_path", "scenario_id", "sample_index",
                      "attempt_count") if c in items.columns],
        F.coalesce("title", "scenario_id").alias("scenario_title"),
        "context_module",
        F.struct(
            F.coalesce("participants.human_id", F.lit("human-1")).alias("human_id"),
            F.coalesce("participants.ai_id", F.lit("ai-1")).alias("ai_id"),
        ).alias("participants"),
        "slot_values",
        F.col("_blueprint.blueprint_id").alias("blueprint_id"),
        turns.alias("turns"),
        variants.alias("turn_variant_choices"),
        F.coalesce(F.size("_templates"), F.lit(0)).alias("turn_count"),
        F.when(missing_template, "no_templates").when(unknown, "unknown_slot").alias("error"),
    )


def generation_items(built: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Catalog row per built item: accepted, failed (with error) or rejected (with reasons).

    `reasons` (interaction_id, reasons) is the quality gate; template mode passes none.
    """
    rows = built
    if reasons is not None:
        rows = rows.join(reasons.select("interaction_id", "reasons"), "interaction_id", "left")
    else:
        rows = rows.withColumn("reasons", F.array().cast("array<string>"))
    few = F.coalesce(F.size("turns"), F.lit(0)) < 2
    incomplete = F.exists(
        "turns", lambda t: t["human_input"].isNull() | t["ai_response"].isNull() | (t["turn_number"] < 0)
    )
    unknown = ~F.coalesce(F.col("context_module"), F.lit("general")).isin(CONTEXTS)
    failure = F.coalesce(F.col("error"), F.when(unknown, "context_module_unknown"), F.when(few, "too_few_turns"), F.when(incomplete, "turn_incomplete"))
    rejected = F.coalesce(F.size("reasons"), F.lit(0)) > 0
    attempt = F.col("attempt_count") if "attempt_count" in built.columns else F.lit(1)
    payload = F.to_json(
        F.struct(
            "interaction_id", "scenario_id", "scenario_title", "slot_values", "blueprint_id",
            "turn_variant_choices", "relative_path", "context_module", "turn_count",
        )
    )
    return rows.select(
        "item_id", "interaction_id", "scenario_id", "sample_index", "relative_path",
        F.when(failure.isNotNull(), "failed").when(rejected, "rejected").otherwise("accepted").alias("status"),
        attempt.cast("int").alias("attempt_count"),
        F.when(failure.isNull(), payload).alias("item_payload"),
        F.when(failure.isNotNull(), failure)
        .when(rejected, F.array_join("reasons", "; "))
        .alias("error_message"),
    )


def generation_progress(items: DataFrame, *, target: Column | int, group: list[str] | None = None) -> DataFrame:
    """Accepted, failed (rejected included), pending and the completeness flag."""
    target = F.lit(target) if isinstance(target, int) else target
    accepted = F.count_if(F.col("status") == "accepted")
    failed = F.count_if(F.col("status") == "failed")
    rejected = F.count_if(F.col("status") == "rejected")
    return items.groupBy(*(group or [])).agg(
        target.cast("bigint").alias("target_item_count"),
        accepted.alias("accepted_count"),
        (failed + rejected).alias("failed_count"),
        F.greatest(F.lit(0), target - accepted - failed - rejected).cast("bigint").alias("pending_count"),
        (accepted == target).alias("is_complete"),
    )
