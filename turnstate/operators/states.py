"""State rows, ordinal deltas between adjacent states, and trajectories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.operators.labels import confidence_error
from turnstate.operators.ordered import CHUNK_ROWS, HOT_ROWS, adjacent, halo
from turnstate.schemas import FIELDS, ORDINAL_VALUES, UNORDERED_VALUES

# Vectors held by one nested trajectory row; longer trajectories continue in further parts.
PART_VECTORS = 10_000


def timestamp_text(*candidates: Column, run_clock: str) -> Column:
    """First non-empty timestamp text, else the clock of the run (a parameter)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(run_clock))


def states(
    labels: DataFrame, *, run_clock: str, meta_time: Column | None = None,
    turn_time: Column | None = None, extensions: Column | None = None,
) -> DataFrame:
    """Canonical state of every labelled turn; bad confidence levels become `error`."""
    times = [c for c in (meta_time, turn_time) if c is not None]
    levels = F.col("confidence")
    some_level = F.coalesce(*[levels[f] for f in FIELDS]).isNotNull()
    context = F.coalesce(F.col("context_module"), F.lit("general"))
    extra = extensions if extensions is not None else F.lit(None).cast("map<string,string>")
    return labels.select(
        timestamp_text(*times, run_clock=run_clock).alias("timestamp"),
        "interaction_id",
        "pos",
        "turn_number",
        *FIELDS,
        context.alias("context_module"),
        F.when(some_level, levels).alias("confidence"),
        F.when(context != "general", extra).alias("extensions"),
        F.coalesce(F.col("error"), confidence_error(levels)).alias("error"),
    )


def _ordinal(value: Column, ordered: Sequence[str]) -> Column:
    number = F.when(F.lit(False), F.lit(0))
    for index, name in enumerate(ordered):
        number = number.when(value == name, F.lit(index))
    return number


def delta(before: Column, after: Column, ordered: Sequence[str]) -> Column:
    """Ordinal step scaled to [-1, 1]; NULL where either value has no ordinal."""
    return (_ordinal(after, ordered) - _ordinal(before, ordered)) / F.lit(float(len(ordered) - 1))


def _delta_error(field: str, before: Column, after: Column, scales, unordered) -> Column:
    known = scales[field]
    free = unordered.get(field, [])
    exempt = before.isin(free) | after.isin(free) if free else F.lit(False)
    valid = before.isin(known) & after.isin(known)
    return F.when(
        ~(F.coalesce(exempt, F.lit(False)) | F.coalesce(valid, F.lit(False))),
        F.lit(f"invalid_transition_{field}"),
    )


def _delta_columns(before: Column, now: Column, scales, unordered) -> list[Column]:
    return [
        *[
            delta(before[f], now[f], ordered).alias(f"delta_{f}")
            for f, ordered in scales.items()
        ],
        F.coalesce(
            F.when(now["turn_number"] <= before["turn_number"], F.lit("non_increasing_turns")),
            *[_delta_error(f, before[f], now[f], scales, unordered) for f in scales],
        ).alias("error"),
    ]


def deltas(
    state_rows: DataFrame, *, chunk_rows: int = CHUNK_ROWS,
    scales: Mapping[str, Sequence[str]] = ORDINAL_VALUES,
    unordered: Mapping[str, Sequence[str]] = UNORDERED_VALUES,
) -> DataFrame:
    """Difference adjacent states of each interaction, `pos` giving the order."""
    members = ["turn_number", *scales, "context_module"]
    rows = state_rows.select("interaction_id", "pos", *members)
    rows, window, own = halo(rows, ["interaction_id"], before=1, chunk_rows=chunk_rows)
    rows = rows.withColumn("_before", F.lag(F.struct(*members)).over(window)).filter(
        own & F.col("_before").isNotNull()
    )
    before, now = F.col("_before"), F.struct(*members)
    return rows.select(
        "interaction_id",
        "pos",
        before["turn_number"].alias("from_turn"),
        F.col("turn_number").alias("to_turn"),
        *_delta_columns(before, now, scales, unordered),
        F.coalesce(F.col("context_module"), before["context_module"], F.lit("general")).alias(
            "context_module"
        ),
    )


def ordinal_steps(
    rows: DataFrame, key: str, order_by: Sequence[str], value: str,
    ordered: Sequence[str], *, max_rows: int = HOT_ROWS,
) -> DataFrame:
    """The same step over any keyed sequence of one categorical column."""
    seen = adjacent(
        rows.select(key, *order_by, value), [key], order_by,
        previous=[*order_by, value], max_rows=max_rows,
    ).filter(F.col("previous").isNotNull())
    return seen.select(
        key,
        *[F.col("previous")[c].alias(f"from_{c}") for c in order_by],
        *[F.col(c).alias(f"to_{c}") for c in order_by],
        delta(F.col("previous")[value], F.col(value), ordered).alias("delta"),
    )


def continuity(vectors: DataFrame, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flag each vector whose turns do not rise or do not follow the one before it."""
    rows, window, own = halo(vectors, ["interaction_id"], before=1, chunk_rows=chunk_rows)
    last = F.lag("to_turn").over(window)
    problem = (
        F.when(F.col("from_turn") >= F.col("to_turn"), "non_increasing")
        .when(F.col("from_turn") != last, "broken")
    )
    return rows.withColumn("problem", problem).filter(own).drop("_chunk")


def interaction_continuity(interactions: DataFrame, vectors: DataFrame) -> DataFrame:
    """First continuity problem per interaction; one without vectors is `empty`."""
    checked = continuity(vectors)
    worst = checked.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("pos"))).alias("problem"),
    )
    return interactions.select("interaction_id").join(worst, "interaction_id", "left").select(
        "interaction_id",
        F.coalesce(F.col("vectors"), F.lit(0)).alias("vectors"),
        F.when(F.col("vectors").isNull(), "empty").otherwise(F.col("problem")).alias("problem"),
    )


def trajectories(vectors: DataFrame, *, part_vectors: int = PART_VECTORS) -> DataFrame:
    """Nest vectors in order. A part holds at most `part_vectors`, so no row is unbounded;
    an ordinary interaction is a single part 0."""
    members = ["pos", "from_turn", "to_turn", *[f"delta_{f}" for f in FIELDS], "context_module"]
    nested = (
        vectors.withColumn("part", F.floor((F.col("pos") - 1) / part_vectors).cast("int"))
        .groupBy("interaction_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*members))).alias("vectors"))
    )
    return nested
