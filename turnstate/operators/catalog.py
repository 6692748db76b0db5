"""Run catalog: append-only logs read as latest-by-key views, listings, retry worklists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstate.operators.ordered import HOT_ROWS, adjacent, global_rank, split_hot_keys
from turnstate.session import shared_table

# Retry suffix.
RETRY_SUFFIXES = r"(-retry-\d{2})+$"


def latest(log: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Current rows of an upsert log: the last write of a key, its first `created_at` kept.

    An aggregation with map-side combine, so a key with a third of the log stays cheap.
    """
    rest = [c for c in log.columns if c not in (*keys, "created_at")]
    rows = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"),
        F.min("created_at").alias("created_at"),
    )
    return rows.select(*keys, "created_at", "_row.*")


def fetch(view: DataFrame, **key: str) -> DataFrame:
    """Rows with the given key values; the filter reaches the scan."""
    for name, value in key.items():
        view = view.filter(F.col(name) == value)
    return view


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to every wanted value; a value of None leaves its column free."""
    return fetch(rows, **{k: v for k, v in wanted.items() if v is not None})


def runs_with_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with the scenario of their interaction. A run without dataset matches the
    interaction in every dataset."""
    right = items.select(
        F.col("interaction_id").alias("_interaction"), F.col("dataset_id").alias("_dataset"),
        F.col("scenario_id").alias("catalog_scenario_id"),
        F.col("blueprint_id").alias("catalog_blueprint_id"),
    )
    same = (F.col("interaction_id") == F.col("_interaction")) & (
        F.col("dataset_id").isNull() | (F.col("_dataset") == F.col("dataset_id"))
    )
    return runs.join(right, same, "left").drop("_interaction", "_dataset")


def _filtered_runs(
    runs, items, *, status=None, dataset_id=None, dataset_run_id=None, scenario_id=None, track_name=None
) -> DataFrame:
    kept = matching(
        runs, status=status, dataset_id=dataset_id, dataset_run_id=dataset_run_id, track_name=track_name
    )
    return matching(runs_with_items(kept, items), catalog_scenario_id=scenario_id)


def list_runs(runs: DataFrame, items: DataFrame, *, limit: int | None = None, **filters) -> DataFrame:
    """Newest first, then by id."""
    rows = _filtered_runs(runs, items, **filters).orderBy(F.desc("updated_at"), "run_id")
    return rows if limit is None else rows.limit(limit)


def runs_by_scenario(runs: DataFrame, items: DataFrame, **filters) -> DataFrame:
    return (
        _filtered_runs(runs, items, **filters)
        .groupBy(F.coalesce("catalog_scenario_id", F.lit("unknown")).alias("scenario_id"), "status")
        .agg(F.count(F.lit(1)).alias("run_count"))
        .orderBy(F.desc("run_count"), "scenario_id")
    )


def list_dataset_runs(dataset_runs: DataFrame, *, limit: int | None = None, **filters) -> DataFrame:
    """Filters: status, dataset_id, scenario_id, track_name."""
    rows = matching(dataset_runs, **filters).orderBy(F.desc("updated_at"), "dataset_run_id")
    return rows if limit is None else rows.limit(limit)


def list_generation_runs(generation_runs: DataFrame, *, limit: int | None = None, **filters) -> DataFrame:
    """Filters: status, dataset_id, generation_mode."""
    rows = matching(generation_runs, **filters).orderBy(F.desc("updated_at"), "generation_run_id")
    return rows if limit is None else rows.limit(limit)


def list_generation_items(items: DataFrame, generation_run_id: str) -> DataFrame:
    return fetch(items, generation_run_id=generation_run_id).orderBy("scenario_id", "sample_index")


def list_failed_generation_items(items: DataFrame, generation_run_id: str, *, limit: int | None = None) -> DataFrame:
    rows = list_generation_items(items.filter(F.col("status").isin("failed", "rejected")), generation_run_id)
    return rows if limit is None else rows.limit(limit)


def partial_generation_report(
    generation_runs: DataFrame, items: DataFrame, generation_run_id: str, *, preview: int = 10
) -> DataFrame:
    """Header of one generation run with its first failed items."""
    failed = list_failed_generation_items(items, generation_run_id, limit=preview)
    nested = failed.groupBy("generation_run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("scenario_id", "sample_index", "item_id", "status", "error_message"))
        ).alias("failed_items")
    )
    header = fetch(generation_runs, generation_run_id=generation_run_id).select(
        "generation_run_id", "status", "accepted_count", "failed_count", "dataset_root"
    )
    return header.join(nested, "generation_run_id", "left")


def run_list_position(selected: DataFrame) -> DataFrame:
    """1-based place of each selected run, newest first, without a one-task sort."""
    day = F.datediff(F.lit("1970-01-01"), F.try_to_date(F.substring("updated_at", 1, 10)))
    tie = [F.col(c) for c in ("catalog_scenario_id", "catalog_blueprint_id") if c in selected.columns]
    # With every digit taken from nine, newest first is the rising order of the text, so a bucket
    # can be cut at any row: all runs of a job share one run clock.
    newest = F.translate("updated_at", "0123456789", "9876543210")
    order = [newest, F.col("run_id"), *tie]
    return global_rank(
        selected, F.coalesce(day, F.lit(2**31 - 1)), order, position=F.struct(*order), name="position"
    )


def base_run_id(run_id: Column) -> Column:
    return F.regexp_replace(run_id, RETRY_SUFFIXES, "")


def retry_ids(
    positioned: DataFrame, existing: DataFrame, *, max_rows: int = HOT_ROWS, saved: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Give each selected run the next free retry index at or above its position.

    Runs of the same base id take their index in order of position and never share one.
    With `free(x)` the number of free indexes below x, the k-th run of a base takes the
    free index of rank k + max over j <= k of (free(position_j) - j).

    Used indexes and positions are merged into one sequence per base, and every figure is a
    running count or maximum over it, so a base with any number of retries is cut into chunks.
    Each pass reads the one before it as a written table: by `saved`, or in the shared folder.
    """
    saved = saved or (lambda df: shared_table(df, "retries"))
    folder = F.regexp_replace("run_dir", r"/[^/]*$", "")
    index = F.regexp_extract("run_id", r"-retry-(\d{2,})$", 1)
    used = existing.select(
        folder.alias("_root"),
        F.regexp_replace("run_id", r"-retry-\d{2,}$", "").alias("_base"),
        index.alias("_index"),
    ).filter(F.col("_index") != "")
    used = used.select("_root", "_base", F.col("_index").cast("bigint").alias("_at")).distinct()
    base, order = ["_root", "_base"], ["_at", "_side", "_tie"]
    rows = positioned.select(
        folder.alias("_root"), base_run_id(F.col("run_id")).alias("_base"), F.col("position").cast("bigint").alias("_at"),
        F.struct(*positioned.columns).alias("_row"),
    )
    taken = F.col("_row").isNull()
    # A used index of the same value does not count for a position: the position comes first.
    both = rows.unionByName(used, allowMissingColumns=True)
    both = saved(both.withColumn("_side", taken.cast("int")).withColumn("_tie", F.col("_row.run_id")))
    chunked = split_hot_keys(both, base, F.struct(*order), max_rows=max_rows)
    upto = Window.partitionBy(*base, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = chunked.withColumns({"_below": F.count_if(taken).over(upto), "_k": F.count_if(~taken).over(upto)})
    inside = inside.withColumn("_lead", F.when(~taken, F.col("_at") - F.col("_below") - F.col("_k")))
    # What chunks bring to those after them: counts, and the highest lead on the scale of the whole base.
    earlier = Window.partitionBy(*base).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = inside.filter("_hot").groupBy(*base, "_chunk").agg(*[F.max(c).alias(c) for c in ("_below", "_k", "_lead")])
    ends = ends.withColumn("_before", F.coalesce(F.sum(F.col("_below") + F.col("_k")).over(earlier), F.lit(0)))
    ends = ends.select(
        *base, "_chunk", F.coalesce(F.sum("_below").over(earlier), F.lit(0)).alias("_used"), "_before",
        F.max(F.col("_lead") - F.col("_before")).over(earlier).alias("_highest"),
    )
    inside = inside.withColumn("_most", F.max("_lead").over(upto)).join(F.broadcast(ends), [*base, "_chunk"], "left")
    below = F.col("_below") + F.coalesce("_used", F.lit(0))
    highest = F.greatest("_highest", F.col("_most") - F.coalesce("_before", F.lit(0)))
    k = F.col("_k") + F.coalesce("_before", F.lit(0)) - F.coalesce("_used", F.lit(0))
    # Used indexes as the number of free ones below them, positions as the rank of their free index.
    value = F.when(taken, F.col("_at") - below + 1).otherwise(k + highest)
    ranked = saved(inside.select(*base, value.alias("_at"), "_row", F.when(taken, 0).otherwise(1).alias("_side"), "_tie"))
    slot = adjacent(ranked, base, order, counts={"_filled": taken}, max_rows=max_rows).filter(~taken)
    number = F.format_string("%02d", F.col("_at") + F.col("_filled"))
    named = slot.withColumn("retry_run_id", F.concat(F.col("_base"), F.lit("-retry-"), number))
    return named.select("_row.*", "retry_run_id")


def retry_worklist(
    runs: DataFrame, items: DataFrame, *, reuse_run_id: bool = False, status: str = "failed",
    limit: int | None = None, **filters,
) -> DataFrame:
    """Failed runs to start again, each with the id it should use."""
    selected = list_runs(runs, items, status=status, limit=limit, **filters)
    positioned = run_list_position(selected)
    if reuse_run_id:
        named = positioned.withColumn("retry_run_id", F.col("run_id"))
    else:
        named = retry_ids(positioned, runs.select("run_id", "run_dir"))
    return named.select(
        "position", F.col("run_id").alias("original_run_id"), "retry_run_id", "input_path",
        "track_name", "dataset_id", "dataset_run_id", "interaction_id",
    )
