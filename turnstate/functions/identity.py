"""Run and dataset identities, and the status words derived from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_run_id(
    root: Column, track: Column, split: Column, scenario: Column, max_items: Column
) -> Column:
    """`dsr-<track>[-split]-<12 hex digits>`; an empty split or scenario counts as absent."""
    some_split = F.nullif(split, F.lit(""))
    some_scenario = F.nullif(scenario, F.lit(""))
    key = F.concat_ws(
        ":",
        root,
        F.coalesce(track, F.lit("")),
        some_split,
        F.concat(F.lit("scenario="), some_scenario),
        F.concat(F.lit("max="), max_items.cast("string")),
    )
    label = F.concat_ws("-", F.coalesce(F.nullif(track, F.lit("")), F.lit("run")), some_split)
    return F.concat(F.lit("dsr-"), label, F.lit("-"), F.substring(F.sha2(key, 256), 1, 12))


def generation_run_id(root: Column, mode: Column, seed: Column, count: Column) -> Column:
    return F.concat_ws(
        "::",
        root,
        mode,
        F.concat(F.lit("seed="), seed.cast("string")),
        F.concat(F.lit("count="), count.cast("string")),
    )


def run_status(items: Column, completed: Column, failed: Column) -> Column:
    return (
        F.when(items == 0, "no_items_matched")
        .when(failed == 0, "completed")
        .when(completed == 0, "failed")
        .otherwise("partial")
    )


def margin_level(margin: Column) -> Column:
    return F.when(margin >= 1.5, "high").when(margin >= 0.75, "medium").otherwise("low")
