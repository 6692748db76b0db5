"""Turn a flat chat log into ordered human/AI turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstate.operators.ordered import HOT_ROWS, adjacent


def turns_from_chat(
    log: DataFrame,
    *,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per user message; the reply is the next message if an assistant wrote it.

    `pos` counts the user messages of a conversation from 0 and is dense.
    """
    seen = adjacent(
        log.select(key, order, role, text),
        [key],
        [order],
        following=[role, text],
        counted=F.col(role) == "user",
        max_rows=max_rows,
    )
    reply = F.when(F.col("following")[role] == "assistant", F.col("following")[text])
    return seen.filter(F.col(role) == "user").select(
        F.col(key),
        (F.col("counted") - 1).cast("int").alias("pos"),
        (F.col("counted") - 1).cast("int").alias("turn_number"),
        F.coalesce(F.col(text), F.lit("")).alias("human_input"),
        F.coalesce(reply, F.lit("")).alias("ai_response"),
    )
