"""Quality gate: reasons to reject an interaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstate.functions.text import (
    ASK_PATTERN,
    BANNED_PATTERN,
    HANDOVER_PATTERN,
    strip,
    tokens,
)

# Least tokens and least share of distinct tokens.
MIN_TOKENS = 30
MIN_DIVERSITY = 0.32


def quality_gate(turns: DataFrame, interactions: DataFrame) -> DataFrame:
    """Sorted reasons per interaction; `turns` has the texts and the hinted `holder`.

    Tokens, turn pairs and turn flags of an interaction become counted entries, so two
    aggregations with map-side combine do all the work and no interaction is gathered.
    """
    human = strip(F.coalesce(F.col("human_input"), F.lit("")))
    reply = strip(F.coalesce(F.col("ai_response"), F.lit("")))
    low = F.lower(human)
    holder = F.coalesce(F.col("holder"), F.lit(""))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    flags = F.array_compact(
        F.array(
            F.when(
                F.rlike(low, F.lit(BANNED_PATTERN)) | F.rlike(F.lower(reply), F.lit(BANNED_PATTERN)),
                F.lit("meta_ai_phrase"),
            ),
            F.when(
                (holder == "AI") & ~F.rlike(low, F.lit(ASK_PATTERN)),
                F.lit("weak_ai_delegation_signal"),
            ),
            F.when(
                (holder == "Human") & F.rlike(low, F.lit(HANDOVER_PATTERN)),
                F.lit("human_turn_overdelegates"),
            ),
        )
    )
    pair = F.sha2(F.lower(F.concat(human, F.lit(" || "), reply)), 256)
    entries = turns.select(
        "interaction_id",
        F.explode(
            F.concat(
                F.transform(F.concat(tokens(human), tokens(reply)), lambda t: entry("token", t)),
                F.array(entry("pair", pair)),
                F.transform(flags, lambda f: entry("flag", f)),
            )
        ).alias("e"),
    ).select("interaction_id", "e.kind", "e.value")
    counted = entries.groupBy("interaction_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    is_kind = lambda k: F.col("kind") == k
    totals = counted.groupBy("interaction_id").agg(
        F.sum(F.when(is_kind("token"), F.col("n")).otherwise(0)).alias("token_count"),
        F.count_if(is_kind("token")).alias("distinct_tokens"),
        F.bool_or(is_kind("pair") & (F.col("n") > 1)).alias("_repeated"),
        # Only three flags exist, so this set is bounded.
        F.collect_set(F.when(is_kind("flag"), F.col("value"))).alias("_flags"),
    )
    joined = interactions.select("interaction_id").join(totals, "interaction_id", "left")
    diversity = F.try_divide("distinct_tokens", "token_count")
    reasons = F.array_sort(
        F.concat(
            F.col("_flags"),
            F.array_compact(
                F.array(
                    F.when(F.col("_repeated"), F.lit("duplicate_turn_pair")),
                    F.when(F.col("token_count") < MIN_TOKENS, F.lit("too_short_tokens")),
                    F.when(diversity < MIN_DIVERSITY, F.lit("low_lexical_diversity")),
                )
            ),
        )
    )
    return joined.select(
        "interaction_id",
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("distinct_tokens", F.lit(0)).alias("distinct_tokens"),
        F.when(F.col("token_count").isNull(), F.array(F.lit("missing_turns")))
        .otherwise(reasons)
        .alias("reasons"),
    )
