"""Label tracks: functions from turns to labels with one output layout.

Input columns: interaction_id, context_module, pos, turn_number, human_input, ai_response.
Output: those plus track_name, model_id, prompt_version, the four labels, `confidence`,
`evidence_spans`, `observer_confidence`, `observer_notes`, `error`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.functions.text import contains_any, excerpt
from turnstate.schemas import CONFIDENCE, FIELDS, LEVELS, SPAN, allowed_values

# Default phrases of the rule track.
DEFAULT_PHRASES = {
    "human_led": ["need help deciding", "help me decide", "trying to decide"],
    "exploration": ["compare", "options", "alternatives", "tradeoffs"],
    "delegation": [
        "what would you choose",
        "you decide",
        "just tell me",
        "what should i do",
        "decide for me",
        "recommend one",
        "recommend for me",
    ],
    "retention": ["i decided", "i will decide", "i choose", "my decision"],
    "hedging": ["maybe", "not sure", "i guess", "probably"],
}
# Per group the four labels, observer confidence, span category and note.
# Later groups override earlier ones.
RULE_OUTCOMES = [
    ("human_led", ("Human", "Explicit", "Active", "Active"), 0.8, "decision_support_signal",
     "Detected human-led decision support request"),
    ("exploration", ("Shared", "Explicit", "Active", "Active"), 0.76, "exploration_signal",
     "Detected option exploration"),
    ("delegation", ("AI", "Explicit", "Reactive", "Passive"), 0.82, "delegation_signal",
     "Detected direct delegation request"),
    ("retention", ("Human", "Explicit", "Active", "Passive"), 0.82, "retention_signal",
     "Detected retained human judgment"),
]
RULE_DEFAULT = (("Undefined", "Absent", "Passive", "None"), 0.68, "default_excerpt",
                "Default baseline assignment")
# Certainty, span category and note of the hint track.
HINT_FACTS = (1.0, "fixture_hint_source", "Canonical fixture hint")
HEDGING = (0.72, "hedging_signal", "Detected hedging language")

TURN_COLUMNS = (
    "interaction_id", "context_module", "pos", "turn_number", "human_input", "ai_response",
    # Where the turns have them, labels carry them on to the states.
    "turn_time", "meta_time", "extensions",
)


def _span(text: Column, category: Column | str) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(
        text.alias("text"), category.alias("category"), F.lit(None).cast("string").alias("note")
    )


def _finish(df: DataFrame, track: str, model: str, version: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *[c for c in TURN_COLUMNS if c in df.columns],
        *[c for c in keep if c in df.columns],
        F.lit(track).alias("track_name"),
        F.lit(model).alias("model_id"),
        F.lit(version).alias("prompt_version"),
        *FIELDS,
        F.col("confidence").cast(CONFIDENCE).alias("confidence"),
        F.col("evidence_spans").cast(T.ArrayType(SPAN)).alias("evidence_spans"),
        F.col("observer_confidence").cast("double").alias("observer_confidence"),
        "observer_notes",
        F.col("error").cast("string").alias("error"),
    )


def rule_labels(
    turns: DataFrame, phrases: Mapping[str, list[str]] = DEFAULT_PHRASES, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Labels from phrase groups found in the lowercased human text; one projection."""
    text = F.lower("human_input")
    hits = {g: F.col(f"_hit_{g}") for g in phrases}
    df = turns.select("*", *[contains_any(text, p).alias(f"_hit_{g}") for g, p in phrases.items()])

    def last_match(index: int, default) -> Column:
        chosen = F.when(F.lit(False), F.lit(default))
        for group, labels, certainty, _, _ in reversed(RULE_OUTCOMES):
            chosen = chosen.when(hits[group], F.lit((*labels, certainty)[index]))
        return chosen.otherwise(F.lit(default))

    labels = {f: last_match(i, RULE_DEFAULT[0][i]) for i, f in enumerate(FIELDS)}
    certainty = last_match(4, RULE_DEFAULT[1])
    hedged = hits["hedging"] & (labels["cognitive_engagement"] == "Active")
    labels["cognitive_engagement"] = F.when(hedged, "Reactive").otherwise(
        labels["cognitive_engagement"]
    )
    found = [(hits[g], category, note) for g, _, _, category, note in RULE_OUTCOMES]
    found.append((hedged, HEDGING[1], HEDGING[2]))
    found.append((~(hits["human_led"] | hits["exploration"] | hits["delegation"] | hits["retention"]),
                  RULE_DEFAULT[2], RULE_DEFAULT[3]))
    source = excerpt(F.col("human_input"), 160)
    df = df.select(
        *turns.columns,
        *[c.alias(f) for f, c in labels.items()],
        F.struct(*[F.lit("low").alias(f) for f in FIELDS]).alias("confidence"),
        F.array_compact(F.array(*[F.when(c, _span(source, cat)) for c, cat, _ in found])).alias(
            "evidence_spans"
        ),
        F.when(hedged, F.greatest(certainty, F.lit(HEDGING[0])))
        .otherwise(certainty)
        .alias("observer_confidence"),
        F.concat_ws("; ", *[F.when(c, F.lit(note)) for c, _, note in found]).alias(
            "observer_notes"
        ),
        F.lit(None).alias("error"),
    )
    return _finish(df, "heuristic_baseline", "rule-based", "heuristic-v1", keep)


def hint_labels(turns: DataFrame, *, hint: str = "hint", keep: Sequence[str] = ()) -> DataFrame:
    """Labels embedded in the input; a turn without one carries an error."""
    df = turns.select(
        *turns.columns,
        *[F.col(hint)[f].alias(f) for f in FIELDS],
        F.col(hint)["confidence"].alias("confidence"),
        *([] if "extensions" in turns.columns else [F.col(hint)["extensions"].alias("extensions")]),
        F.array(_span(excerpt(F.col("human_input"), 160), HINT_FACTS[1])).alias(
            "evidence_spans"
        ),
        F.lit(HINT_FACTS[0]).alias("observer_confidence"),
        F.lit(HINT_FACTS[2]).alias("observer_notes"),
        F.when(F.col(hint).isNull(), "missing_hint").alias("error"),
    )
    return _finish(df, "fixture_hint", "fixture", "fixture-v1", keep)


def confidence_error(confidence: Column) -> Column:
    """First unknown level in field order; NULL levels are skipped."""
    wrong = [
        F.when(~confidence[f].isin(LEVELS), F.lit(f"invalid_confidence_{f}")) for f in FIELDS
    ]
    return F.coalesce(*wrong)


def label_error() -> Column:
    """First label outside its value set, in field order."""
    return F.coalesce(
        *[
            F.when(
                ~F.coalesce(F.col(f).isin(allowed_values(f)), F.lit(False)), F.lit(f"invalid_{f}")
            )
            for f in FIELDS
        ]
    )


def overlays(labels: DataFrame) -> DataFrame:
    """Annotation view of labels; absent confidence and empty notes become NULL."""
    return labels.select(
        "interaction_id",
        "turn_number",
        F.struct(
            F.col("track_name").alias("track_id"), F.col("model_id"), F.col("prompt_version")
        ).alias("track"),
        F.struct(*FIELDS, "confidence").alias("hint"),
        "evidence_spans",
        "observer_confidence",
        F.nullif(F.col("observer_notes"), F.lit("")).alias("observer_notes"),
    )


def extracts(labels: DataFrame, *, stored_at: str) -> DataFrame:
    """Stored form of labels: texts, label, overlay and track facts of one turn."""
    return labels.select(
        "interaction_id",
        "turn_number",
        "pos",
        "track_name",
        "context_module",
        "human_input",
        "ai_response",
        F.struct(*FIELDS, "confidence").alias("jsv_hint"),
        F.struct("evidence_spans").alias("overlay"),
        F.struct(
            F.col("track_name").alias("track_id"),
            "model_id",
            "prompt_version",
            "observer_confidence",
            "observer_notes",
        ).alias("track_metadata"),
        F.lit(stored_at).alias("stored_at"),
    )


def together(turns: DataFrame, tracks: Mapping[str, Callable[..., DataFrame]]) -> DataFrame:
    """The labels of several tracks from one pass over the turns, one row per turn and `label`.

    A track here is a projection that takes the turns and the columns to `keep`, as `rule_labels`
    and `hint_labels` are: each adds its result to the row it reads, and the results of a row
    become rows at the end. Columns that only some tracks give are null for the others.
    """
    base, df, own = turns.columns, turns.select("*", F.struct(*turns.columns).alias("_turn")), {}
    for k, track in enumerate(tracks.values()):
        carried = ["_turn", *own]
        done = track(df, keep=carried)
        lost = [c for c in carried if c not in done.columns]
        if lost:
            raise ValueError("a track that is run together with others keeps the columns it is asked to keep")
        fields = [c for c in done.columns if c not in carried]
        own[f"_out{k}"] = {c: done.schema[c].dataType for c in fields}
        df = done.select(*carried, F.struct(*fields).alias(f"_out{k}")).select(*[f"_turn.{c}" for c in base], *carried, f"_out{k}")
    types = {c: t for fields in own.values() for c, t in fields.items()}
    value = lambda out, c: (F.col(f"{out}.{c}") if c in own[out] else F.lit(None)).cast(types[c]).alias(c)
    rows = [
        F.struct(F.lit(label).alias("label"), *[value(out, c) for c in types]) for label, out in zip(tracks, own)
    ]
    return df.select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")
