"""Prompt text per turn, recorded responses, and the worklist of unresolved turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.functions.responses import normalise
from turnstate.functions.text import excerpt
from turnstate.operators.labels import TURN_COLUMNS, _finish
from turnstate.operators.ordered import CHUNK_ROWS, halo
from turnstate.schemas import CONFIDENCE, FIELDS, SPAN

EARLY_TURNS = 10_000
SALTS = 32
# History length, cut of each side, attempts, and prompt wording.
HISTORY_TURNS = 5
HISTORY_CHARS = 300
MAX_ATTEMPTS = 4
REPAIR_TEXT = (
    "previous_response_was_invalid_json: true\n"
    "repair_instruction: Return one JSON object only. Do not use markdown fences. "
    "Do not add commentary before or after the JSON. "
    "The response must start with { and end with }. "
    "Always include all required fields and at least one evidence span.\n"
    "required_schema_template:\n"
    '{"judgment_holder":"Human|Shared|AI|Undefined",'
    '"delegation_awareness":"Explicit|Implicit|Absent",'
    '"cognitive_engagement":"Active|Reactive|Passive",'
    '"information_seeking":"Active|Passive|None",'
    '"confidence":{"judgment_holder":"high|medium|low",'
    '"delegation_awareness":"high|medium|low",'
    '"cognitive_engagement":"high|medium|low",'
    '"information_seeking":"high|medium|low"},'
    '"evidence_spans":[{"text":"...","category":"..."}],'
    '"observer_notes":"..."}\n'
    "previous_response:\n"
)


def with_history(
    turns: DataFrame, *, length: int = HISTORY_TURNS, chars: int = HISTORY_CHARS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `history` (at most `length` earlier turns, sides cut) and `context_turn_count`."""
    rows, window, own = halo(turns, ["interaction_id"], before=length, chunk_rows=chunk_rows)
    turn = F.struct(
        "turn_number",
        excerpt(F.col("human_input"), chars).alias("human_input"),
        excerpt(F.col("ai_response"), chars).alias("ai_response"),
    )
    return (
        rows.withColumn("history", F.collect_list(turn).over(window.rowsBetween(-length, -1)))
        .filter(own)
        .withColumn("context_turn_count", F.col("pos"))
        .drop("_chunk")
    )


# The labels of the prompt's lines.
PROMPT_LABELS = {
    "interaction": "interaction_id: ", "context": "\ncontext_module: ", "turn": "\nturn_number: ",
    "history": "conversation_history:\n", "past_human": "] Human: ", "past_ai": "] AI: ", "past": "[turn ",
    "human": "current_turn_human: ", "ai": "\ncurrent_turn_ai: ",
}


def observer_prompt() -> Column:
    """Prompt of one turn from its columns and `history`."""
    mark = {name: F.lit(text) for name, text in PROMPT_LABELS.items()}
    number = lambda t: t["turn_number"].cast("string")
    lines = F.transform(
        "history",
        lambda t: F.concat(
            mark["past"], number(t), mark["past_human"], t["human_input"], F.lit("\n"),
            mark["past"], number(t), mark["past_ai"], t["ai_response"],
        ),
    )
    block = F.when(
        F.size("history") > 0, F.concat(mark["history"], F.array_join(lines, "\n"), F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        mark["interaction"], F.col("interaction_id"), mark["context"], F.col("context_module"),
        mark["turn"], F.col("turn_number").cast("string"), F.lit("\n\n"), block,
        mark["human"], F.col("human_input"), mark["ai"], F.col("ai_response"), F.lit("\n"),
    )


def repair_prompt(prompt: Column, previous_response: Column) -> Column:
    return F.concat(prompt, F.lit("\n" + REPAIR_TEXT), previous_response, F.lit("\n"))


def fallback_responses(turns: DataFrame, by_key: DataFrame, by_turn: DataFrame, default: str | None) -> DataFrame:
    """Response for (interaction, turn), else for the turn number, else the default.

    Low turn numbers are hot keys (every conversation has a turn 0). Each of the at most
    EARLY_TURNS fallback rows for them is repeated per salt, so their turns spread over
    SALTS keys whether Spark broadcasts the rows or shuffles them. A turn without a number
    takes the default.
    """
    keyed = by_key.select(
        "interaction_id", "turn_number", F.col("response_text").alias("_by_key")
    )
    turned = by_turn.groupBy("turn_number").agg(F.max("response_text").alias("_by_turn"))
    salts = F.when(F.col("turn_number").between(0, EARLY_TURNS - 1), SALTS).otherwise(1)
    salted = turned.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    known = turns.join(keyed, ["interaction_id", "turn_number"], "left")
    found = known.withColumn("_salt", F.pmod(F.hash("interaction_id"), salts)).join(
        salted, ["turn_number", "_salt"], "left"
    )
    return (
        found.withColumn("response_text", F.coalesce("_by_key", "_by_turn", F.lit(default)))
        .withColumn(
            "response_source",
            F.when(F.col("_by_key").isNotNull(), "key")
            .when(F.col("_by_turn").isNotNull(), "turn")
            .otherwise("default"),
        )
        .drop("_by_key", "_by_turn", "_salt")
    )


def first_valid_attempt(responses: DataFrame, *, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per model and turn the first of at most `attempts` responses that passes the rules.

    Attempts are taken in the order of their numbers, wherever the log starts to count; of
    repeated log rows of one attempt the largest text stands for it. `next_attempt` is the
    number after the last logged one. One column per attempt holds its response, so the list
    of tried responses cannot grow beyond `attempts`.
    """
    key = ["model_id", "interaction_id", "turn_number"]
    logged = responses.groupBy(*key, "attempt").agg(F.max("response_text").alias("response_text"))
    window = Window.partitionBy(*key)
    ranked = logged.select(
        *key, "response_text",
        (F.max("attempt").over(window) + 1).alias("next_attempt"),
        (F.row_number().over(window.orderBy("attempt")) - 1).alias("attempt"),
    )
    checked = normalise(ranked.filter(F.col("attempt") < attempts))
    good = F.col("parsed.reason").isNull()
    tried = F.array(
        *[
            F.struct(F.lit(a).alias("attempt"), F.max(F.when(F.col("attempt") == a, F.col("response_text"))).alias("response_text"))
            for a in range(attempts)
        ]
    )
    return (
        checked.groupBy(*key)
        .agg(
            F.min(F.when(good, F.col("attempt"))).alias("attempt"),
            F.min_by("parsed", F.when(good, F.col("attempt"))).alias("parsed"),
            F.max_by("parsed", "attempt")["reason"].alias("last_reason"),
            F.max("next_attempt").alias("next_attempt"),
            F.filter(tried, lambda t: t["response_text"].isNotNull()).alias("tried"),
        )
        .withColumn("error", F.when(F.col("attempt").isNull(), F.col("last_reason")))
    )


def observer_labels(
    turns: DataFrame, responses: DataFrame, *, model_id: str, track: str = "llm_observer",
    version: str = "llm-observer-v1",
) -> DataFrame:
    """Labels of one model from recorded responses; turns without any carry an error."""
    resolved = first_valid_attempt(responses.filter(F.col("model_id") == model_id)).select(
        "interaction_id", "turn_number", "parsed", F.col("error").alias("_error"), "tried"
    )
    df = turns.join(resolved, ["interaction_id", "turn_number"], "left")
    accepted = F.col("parsed").isNotNull()
    part = lambda name, kind: F.when(accepted, F.col("parsed")[name]).cast(kind).alias(name)
    df = df.select(
        *[c for c in TURN_COLUMNS if c in turns.columns],
        *[part(f, "string") for f in FIELDS],
        part("confidence", CONFIDENCE),
        part("evidence_spans", T.ArrayType(SPAN)),
        part("observer_confidence", "double"),
        part("observer_notes", "string"),
        F.when(~accepted, F.coalesce(F.col("_error"), F.lit("no_response"))).alias("error"),
        F.transform("tried", lambda t: t["response_text"]).alias("attempt_responses"),
    )
    return _finish(df, track, model_id, version, keep=["attempt_responses"])


def repair_worklist(turns_with_prompt: DataFrame, resolved: DataFrame, *, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Next prompt for turns whose attempts so far all failed and that may try again."""
    failed = resolved.filter(F.col("error").isNotNull() & (F.size("tried") < attempts)).select(
        "model_id", "interaction_id", "turn_number",
        "next_attempt",
        F.element_at("tried", -1)["response_text"].alias("_last"),
    )
    return turns_with_prompt.join(failed, ["interaction_id", "turn_number"]).select(
        "model_id", "interaction_id", "turn_number", "next_attempt",
        repair_prompt(F.col("prompt"), F.col("_last")).alias("prompt"),
    )


def turn_guidance(holder: Column) -> tuple[Column, Column]:
    """Guidance for the human and the assistant side of a planned turn."""
    human = F.when(holder == "AI", GUIDANCE["AI"][0]).when(
        holder == "Shared", GUIDANCE["Shared"][0]
    ).otherwise(GUIDANCE["Human"][0])
    assistant = F.when(holder == "AI", GUIDANCE["AI"][1]).when(
        holder == "Shared", GUIDANCE["Shared"][1]
    ).otherwise(GUIDANCE["Human"][1])
    return human, assistant


# Guidance wording by target holder; `Human` also serves every other value.
GUIDANCE = {
    "AI": (
        "This turn should end with the human asking for a recommendation, judgment call, "
        "or direct choice. The human should not introduce major new facts on this turn.",
        "This turn should answer with a recommendation or clear direction, grounded only "
        "in already stated priorities and constraints. Do not ask another follow-up question.",
    ),
    "Shared": (
        "This turn should sound collaborative: ask for weighing, comparison, or structured help "
        "while staying engaged in the decision.",
        "This turn should compare tradeoffs or structure the decision without taking full ownership.",
    ),
    "Human": (
        "This turn should keep judgment with the human: ask for framing, clarification, or comparison "
        "without handing over the decision.",
        "This turn should help structure the decision without deciding for the human.",
    ),
}
