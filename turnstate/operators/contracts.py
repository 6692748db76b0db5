"""Contract checks as columns: each adds `violations`, a sorted-by-rule array of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.schemas import CONTEXTS, FIELDS, INTERACTION, LEVELS, TURN, allowed_values


def _list(**rules: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )


def _short(text: Column) -> Column:
    return text.isNull() | (text == "")


def turn_violations(turns: DataFrame) -> DataFrame:
    """Raw contract of single turns. The timestamp format is not part of it."""
    return turns.withColumn(
        "violations",
        _list(
            turn_number_missing=F.col("turn_number").isNull(),
            turn_number_negative=F.col("turn_number") < 0,
            human_input_missing=F.col("human_input").isNull(),
            ai_response_missing=F.col("ai_response").isNull(),
        ),
    )


def interaction_violations(turns: DataFrame, interactions: DataFrame) -> DataFrame:
    """Raw contract per interaction, turns flat: counts and flags, never a gathered list.

    `interactions` has interaction_id, context_module, human_id and ai_id.
    """
    flat = (
        turn_violations(turns)
        .groupBy("interaction_id")
        .agg(
            F.count(F.lit(1)).alias("turn_count"),
            *[
                F.bool_or(F.array_contains("violations", code)).alias(f"_{code}")
                for code in TURN_CODES
            ],
        )
    )
    joined = interactions.join(flat, "interaction_id", "left")
    count = F.coalesce(F.col("turn_count"), F.lit(0))
    return joined.select(
        "interaction_id",
        "context_module",
        count.alias("turn_count"),
        _list(
            interaction_id_empty=_short(F.col("interaction_id")),
            context_module_unknown=~F.coalesce(F.col("context_module").isin(CONTEXTS), F.lit(False)),
            human_id_empty=_short(F.col("human_id")),
            ai_id_empty=_short(F.col("ai_id")),
            too_few_turns=count < 2,
            **{code: F.col(f"_{code}") for code in TURN_CODES},
        ).alias("violations"),
    )


TURN_CODES = (
    "turn_number_missing", "turn_number_negative", "human_input_missing", "ai_response_missing",
)


def document_violations(documents: DataFrame, *, raw: str = "raw") -> DataFrame:
    """Raw contract of JSON documents, unknown keys included. Needs the document text."""
    loose = F.from_json(F.col(raw), "participants STRING, turns ARRAY<STRING>")
    known = lambda struct: F.array(*[F.lit(n) for n in struct.fieldNames()])
    extra = lambda text, struct: F.size(
        F.array_except(F.json_object_keys(text), known(struct))
    ) > 0
    turns = F.coalesce(F.col("turns"), F.array().cast(INTERACTION["turns"].dataType))
    return documents.withColumn(
        "violations",
        _list(
            interaction_id_empty=_short(F.col("interaction_id")),
            context_module_unknown=~F.coalesce(F.col("context_module").isin(CONTEXTS), F.lit(False)),
            human_id_empty=_short(F.col("participants.human_id")),
            ai_id_empty=_short(F.col("participants.ai_id")),
            too_few_turns=F.size(turns) < 2,
            turn_number_missing=F.exists(turns, lambda t: t["turn_number"].isNull()),
            turn_number_negative=F.exists(turns, lambda t: t["turn_number"] < 0),
            human_input_missing=F.exists(turns, lambda t: t["human_input"].isNull()),
            ai_response_missing=F.exists(turns, lambda t: t["ai_response"].isNull()),
            unknown_key=extra(F.col(raw), INTERACTION)
            | extra(loose["participants"], INTERACTION["participants"].dataType)
            | F.exists(loose["turns"], lambda t: extra(t, TURN)),
        ),
    )


def state_violations(states: DataFrame) -> DataFrame:
    levels = F.col("confidence")
    return states.withColumn(
        "violations",
        _list(
            interaction_id_empty=_short(F.col("interaction_id")),
            turn_number_negative=F.coalesce(F.col("turn_number") < 0, F.lit(True)),
            timestamp_invalid=~F.rlike("timestamp", F.lit(DATE_TIME))
            | F.try_to_timestamp("timestamp").isNull(),
            context_module_unknown=~F.coalesce(F.col("context_module").isin(CONTEXTS), F.lit(False)),
            extensions_missing=(F.col("context_module") != "general") & F.col("extensions").isNull(),
            **{
                f"invalid_{f}": ~F.coalesce(F.col(f).isin(allowed_values(f)), F.lit(False))
                for f in FIELDS
            },
            **{f"invalid_confidence_{f}": ~levels[f].isin(LEVELS) for f in FIELDS},
        ),
    )


# Fixed value: date-time text with a zone.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def delta_violations(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn(
        "violations",
        _list(
            interaction_id_empty=_short(F.col("interaction_id")),
            **{
                f"delta_{f}_out_of_range": ~F.col(f"delta_{f}").between(-1.0, 1.0) for f in FIELDS
            },
            **{
                f"delta_{f}_missing": F.col(f"delta_{f}").isNull()
                for f in FIELDS
                if f != "judgment_holder"
            },
        ),
    )


def trajectory_violations(trajectories: DataFrame) -> DataFrame:
    """At least one vector, each of them valid."""
    in_range = lambda v: F.coalesce(
        F.array_min(F.array(*[F.coalesce(v[f"delta_{f}"], F.lit(0.0)) for f in FIELDS])) >= -1,
        F.lit(True),
    ) & (F.array_max(F.array(*[F.coalesce(v[f"delta_{f}"], F.lit(0.0)) for f in FIELDS])) <= 1)
    filled = lambda v: F.array_contains(
        F.array(*[v[f"delta_{f}"].isNull() for f in FIELDS if f != "judgment_holder"]), True
    )
    return trajectories.withColumn(
        "violations",
        _list(
            no_vectors=F.size("vectors") < 1,
            vector_out_of_range=F.exists("vectors", lambda v: ~in_range(v)),
            vector_incomplete=F.exists("vectors", filled),
        ),
    )


def overlay_violations(overlays: DataFrame) -> DataFrame:
    spans = F.col("evidence_spans")
    return overlays.withColumn(
        "violations",
        _list(
            interaction_id_empty=_short(F.col("interaction_id")),
            turn_number_negative=F.coalesce(F.col("turn_number") < 0, F.lit(True)),
            track_id_empty=_short(F.col("track.track_id")),
            hint_missing=F.col("hint").isNull(),
            spans_missing=spans.isNull(),
            span_text_empty=F.exists(spans, lambda s: _short(s["text"])),
            span_category_empty=F.exists(spans, lambda s: _short(s["category"])),
            observer_confidence_out_of_range=~F.col("observer_confidence").between(0.0, 1.0),
        ),
    )


def first_errors(turn_rows: DataFrame) -> DataFrame:
    """First error of every interaction that has one: by `stage` where there is one, since a
    later stage repeats the errors of an earlier one, then in turn order."""
    order = F.struct(*[c for c in ("stage", "pos") if c in turn_rows.columns], "error")
    return (
        turn_rows.filter(F.col("error").isNotNull())
        .groupBy("interaction_id")
        .agg(
            F.min_by("error", order).alias("error"),
            F.min_by("pos", order).alias("pos"),
            F.count(F.lit(1)).alias("failed_turns"),
        )
    )


def all_or_nothing(turn_rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of interactions without any error. The failed ids are aggregated first, so the
    join carries one row per failed interaction; a hot interaction is split by the adaptive
    skew join, which a window over the interaction could not be."""
    return turn_rows.join(errors.select("interaction_id"), "interaction_id", "left_anti")


def response_shape_violations(responses: DataFrame) -> DataFrame:
    """Rewritten turns (`received`) against the planned ones (`expected`): count, numbering
    and non-empty texts."""
    expected, received = F.col("expected"), F.col("received")
    blank = lambda c: F.coalesce(F.rlike(c, F.lit(r"^(?U)\s*$")), F.lit(True))
    same_size = F.size(received) == F.size(expected)
    numbers = F.zip_with(
        expected, received, lambda e, r: F.coalesce(r["turn_number"], F.lit(-1)) == e["turn_number"]
    )
    return responses.withColumn(
        "violations",
        _list(
            turn_list_invalid=~F.coalesce(same_size, F.lit(False)),
            turn_numbering=same_size & F.exists(numbers, lambda ok: ~ok),
            human_input_empty=same_size & F.exists(received, lambda r: blank(r["human_input"])),
            ai_response_empty=same_size & F.exists(received, lambda r: blank(r["ai_response"])),
        ),
    )
