"""Resume and progress: which turns may reuse a stored label, and how far a run is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstate.functions.identity import run_status

KEY = ["interaction_id", "turn_number"]
# Turn numbers listed by one progress row; longer runs continue in further parts.
PART_TURNS = 10_000


def with_stored(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """Add `reusable`: a stored row exists and both texts are the same (NULL equals '').

    A changed context does not count. `stored` has the key, the texts and `seq`.
    """
    kept = stored.groupBy(*KEY).agg(
        F.max_by(
            F.struct(
                F.coalesce("human_input", F.lit("")).alias("human_input"),
                F.coalesce("ai_response", F.lit("")).alias("ai_response"),
            ),
            "seq",
        ).alias("_stored")
    )
    same = (F.col("_stored.human_input") == F.coalesce("human_input", F.lit(""))) & (
        F.col("_stored.ai_response") == F.coalesce("ai_response", F.lit(""))
    )
    return turns.join(kept, KEY, "left").withColumn(
        "reusable", F.coalesce(same, F.lit(False))
    ).drop("_stored")


def reused_turns(turns: DataFrame, stored: DataFrame) -> DataFrame:
    return with_stored(turns, stored).filter("reusable").drop("reusable")


def turns_to_process(turns: DataFrame, stored: DataFrame) -> DataFrame:
    return with_stored(turns, stored).filter(~F.col("reusable")).drop("reusable")


def run_progress(marked: DataFrame) -> DataFrame:
    """Counts per interaction from turns marked `reusable` and `done`."""
    done, reused = F.col("done"), F.col("reusable")
    return marked.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(done).alias("completed_turns"),
        F.count_if(done & reused).alias("resumed_count"),
        F.count_if(done & ~reused).alias("written_count"),
        F.when(F.bool_and(done), "completed").otherwise("running").alias("status"),
    )


def progress_turns(marked: DataFrame, *, part_turns: int = PART_TURNS) -> DataFrame:
    """Resumed and written turn numbers in order, in parts of bounded length."""
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col("done") & c, F.col("turn_number"))))
    return (
        marked.withColumn("part", F.floor(F.col("pos") / part_turns).cast("int"))
        .groupBy("interaction_id", "part")
        .agg(
            listed(F.col("reusable")).alias("resumed_turns"),
            listed(~F.col("reusable")).alias("written_turns"),
        )
    )


def dataset_run_counts(items: DataFrame, group: list[str]) -> DataFrame:
    """Items, completed, failed and the status word of each dataset run."""
    completed = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    total = F.count(F.lit(1))
    return items.groupBy(*group).agg(
        total.alias("item_count"),
        completed.alias("completed_count"),
        failed.alias("failed_count"),
        run_status(total, completed, failed).alias("status"),
    )
