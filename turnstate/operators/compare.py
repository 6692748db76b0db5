"""Comparison of labels from several runs: disagreement, ensembles, breakdowns, gates.

Label rows: run_key, interaction_id, turn_number, seq, the four labels and `confidence`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.schemas import FIELDS

TURN_KEY = ["interaction_id", "turn_number"]


def last_per_turn(labels: DataFrame) -> DataFrame:
    """The last stored row of each run and turn wins."""
    rest = [c for c in labels.columns if c not in ("run_key", *TURN_KEY)]
    return (
        labels.groupBy("run_key", *TURN_KEY)
        .agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
        .select("run_key", *TURN_KEY, "_last.*")
    )


def majority(values: Column) -> Column:
    """Most frequent of the non-null values of a short list; a tie goes to the first in
    alphabetical order."""
    known = F.array_compact(values)
    votes = F.transform(
        F.array_sort(F.array_distinct(known)),
        lambda v, i: F.struct(F.size(F.filter(known, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")),
    )
    return F.array_max(votes)["v"]


def turn_comparisons(labels: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """One row per turn over all its runs. The lists hold one entry per run, and the number
    of runs is the number of compared methods.

    With `runs` given, a missing run is one of that list; otherwise one of the runs that
    label the interaction at all.
    """
    levels = F.struct(*[F.coalesce(F.col("confidence")[f], F.lit("medium")).alias(f) for f in FIELDS])
    entry = F.struct("run_key", F.struct(*FIELDS).alias("values"), levels.alias("levels"))
    rows = labels.groupBy(*TURN_KEY).agg(
        F.count(F.lit(1)).alias("present"),
        F.array_sort(F.collect_list(entry)).alias("_runs"),
        *[(F.min(f) != F.max(f)).cast("int").alias(f"differs_{f}") for f in FIELDS],
    )
    each = lambda part, f: F.transform("_runs", lambda r: r[part][f])
    rows = rows.select(
        *TURN_KEY,
        "present",
        F.array_distinct(F.col("_runs.run_key")).alias("runs_present"),
        F.map_from_arrays(F.col("_runs.run_key"), F.col("_runs.values")).alias("run_values"),
        *[f"differs_{f}" for f in FIELDS],
        *[majority(each("values", f)).alias(f"ensemble_{f}") for f in FIELDS],
        *[majority(each("levels", f)).alias(f"ensemble_confidence_{f}") for f in FIELDS],
    )
    if runs is not None:
        expected = F.array(*[F.lit(r) for r in runs])
        rows = rows.withColumn("runs_expected", expected)
    else:
        known = labels.groupBy("interaction_id").agg(
            F.array_sort(F.collect_set("run_key")).alias("runs_expected")
        )
        rows = rows.join(known, "interaction_id")
    names = F.array_compact(
        F.array(*[F.when(F.col(f"differs_{f}") == 1, F.lit(f)) for f in FIELDS])
    )
    score = sum((F.col(f"differs_{f}") for f in FIELDS), F.lit(0)) / F.lit(float(len(FIELDS)))
    return rows.select(
        *TURN_KEY,
        "present",
        "runs_present",
        F.array_except("runs_expected", "runs_present").alias("runs_missing"),
        "run_values",
        names.alias("disagreement_fields"),
        score.alias("disagreement_score"),
        *[f"differs_{f}" for f in FIELDS],
        *[f"ensemble_{f}" for f in FIELDS],
        *[f"ensemble_confidence_{f}" for f in FIELDS],
    )


def comparable(turns: DataFrame) -> DataFrame:
    """Turns that at least two runs labelled; the others stay out of every rate."""
    return turns.filter(F.col("present") >= 2)


def _slim(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The turn grain without ensembles and lists, for rates alone."""
    return labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"),
        *[(F.min(f) != F.max(f)).cast("int").alias(f"differs_{f}") for f in FIELDS],
    )


def comparison_summary(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per interaction: turns compared, skipped and total, overall and per-field rates."""
    group = list(group)
    turns = _slim(labels, [*group, *TURN_KEY])
    used = F.col("present") >= 2
    compared = F.count_if(used)
    differs = {f: F.sum(F.when(used, F.col(f"differs_{f}"))) for f in FIELDS}
    rate = lambda hits, base: F.coalesce(F.try_divide(hits, base), F.lit(0.0))
    return turns.groupBy(*group, "interaction_id").agg(
        compared.alias("turns_compared"),
        F.count(F.lit(1)).alias("turns_total"),
        F.count_if(~used).alias("turns_skipped"),
        rate(sum(differs.values(), F.lit(0)), compared * len(FIELDS)).alias("rate"),
        *[rate(differs[f], compared).alias(f"rate_{f}") for f in FIELDS],
    )


def single_interaction_check(labels: DataFrame, group: Sequence[str]) -> DataFrame:
    """Comparisons may hold one interaction only; others get an error."""
    ids = F.count_distinct("interaction_id")
    return labels.groupBy(*group).agg(
        ids.alias("interactions"),
        F.when(ids != 1, "mixed_interactions").alias("error"),
    )


def rate_breakdown(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of item rates for each single key and overall, in one pass.

    Items: one row per interaction with `rate`, `rate_<field>` and `example_count`.
    """
    grouped = items.groupingSets([[k] for k in keys] + [[]], *keys)
    scope = F.coalesce(
        *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys], F.lit("overall")
    )
    label = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in keys], F.lit("all"))
    return grouped.agg(
        scope.alias("scope"),
        label.alias("group"),
        F.count(F.lit(1)).alias("item_count"),
        F.avg("rate").alias("average_rate"),
        F.avg("example_count").alias("average_example_count"),
        *[F.avg(f"rate_{f}").alias(f"average_rate_{f}") for f in FIELDS],
    ).drop(*keys)


def benchmark_summary(items: DataFrame) -> DataFrame:
    """Overall figures of a benchmark; 0 where there are no items."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return items.agg(
        F.count(F.lit(1)).alias("item_count"),
        zero(F.avg("example_count")).alias("average_example_count"),
        zero(F.avg("rate")).alias("average_rate"),
        zero(F.min("rate")).alias("min_rate"),
        zero(F.max("rate")).alias("max_rate"),
        F.count_if(F.col("rate") == 0).alias("zero_disagreement_items"),
        *[zero(F.avg(f"rate_{f}")).alias(f"average_rate_{f}") for f in FIELDS],
    )


def threshold_gate(
    summary: DataFrame, *, max_average: float | None = None, max_item: float | None = None
) -> DataFrame:
    """One row per configured limit; only a value strictly above its limit fails."""
    gates = [
        F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"), F.lit(float(l)).alias("limit"))
        for n, c, l in (
            ("average_field_disagreement_rate", "average_rate", max_average),
            ("max_field_disagreement_rate", "max_rate", max_item),
        )
        if l is not None
    ]
    if not gates:
        return summary.limit(0).select(
            F.lit("").alias("metric"), F.lit(0.0).alias("value"), F.lit(0.0).alias("limit"),
            F.lit(True).alias("passed"),
        )
    return (
        summary.select(F.explode(F.array(*gates)).alias("g"))
        .select("g.*")
        .withColumn("passed", ~(F.col("value") > F.col("limit")))
    )


def pairwise_against_baseline(labels: DataFrame, baseline: str) -> DataFrame:
    """Rates of each label against the baseline per interaction both completed.

    Label rows carry `label` and are read once: a turn gathers one entry per compared label,
    the entries meet the baseline's inside the row, and the sums of an interaction gather one
    entry per label again to see whether the baseline has that interaction at all.
    """
    is_base = F.col("label") == baseline
    turn = labels.groupBy(*TURN_KEY).agg(
        F.max(F.when(is_base, F.struct(*FIELDS))).alias("base"), F.collect_list(F.struct("label", *FIELDS)).alias("entries")
    )
    entries = turn.select("interaction_id", "base", F.explode("entries").alias("e"))
    compared = F.col("base").isNotNull()
    sums = entries.groupBy("interaction_id", "e.label").agg(
        F.count_if(compared).alias("turns_compared"),
        *[F.avg(F.when(compared, (F.col("e")[f] != F.col("base")[f]).cast("int"))).alias(f"rate_{f}") for f in FIELDS],
    )
    rates = [f"rate_{f}" for f in FIELDS]
    items = sums.groupBy("interaction_id").agg(
        F.collect_list(F.struct("label", "turns_compared", *rates)).alias("r"), F.max(is_base).alias("based")
    )
    rows = items.filter("based").select("interaction_id", F.explode("r").alias("r")).select("interaction_id", "r.*").filter(~is_base)
    rows = rows.fillna(0.0, subset=rates)
    return rows.select(
        "label", "interaction_id", "turns_compared",
        (sum((F.col(r) for r in rates), F.lit(0.0)) / len(FIELDS)).alias("rate"), *rates,
    )


def matrix_summary(pairs: DataFrame, labels: DataFrame | None = None, baseline: str | None = None) -> DataFrame:
    """Items and rates per label. With all `labels` given, one that shares no item with the
    baseline is listed with zeros."""
    found = pairs.groupBy("label").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.avg("rate").alias("average_rate"),
        F.max("rate").alias("max_rate"),
    )
    if labels is None:
        return found
    every = labels.filter(F.col("label") != F.lit(baseline)).select("label").distinct()
    zero = {"item_count": F.lit(0).cast("bigint"), "average_rate": F.lit(0.0), "max_rate": F.lit(0.0)}
    return every.join(found, "label", "left").select(
        "label", *[F.coalesce(c, z).alias(c) for c, z in zero.items()]
    )


def distinct_runs(runs: DataFrame, baseline: str) -> DataFrame:
    """Run folders of an interaction without repeats, baseline first, then label order."""
    first = F.min(F.struct((F.col("label") != baseline).alias("later"), F.col("position")))
    return (
        runs.groupBy("interaction_id", "run_dir")
        .agg(first.alias("_first"))
        .select(
            "interaction_id", "run_dir",
            F.col("_first.later").alias("later"), F.col("_first.position").alias("position"),
        )
    )


def top_fields(summary: DataFrame, n: int = 3) -> DataFrame:
    """Fields with the highest mean rate."""
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"average_rate_{f}").alias("rate")) for f in FIELDS]
    )
    return (
        summary.select(F.explode(entries).alias("e")).select("e.*")
        .orderBy(F.desc("rate"), "field").limit(n)
    )


def top_items(items: DataFrame, n: int = 3) -> DataFrame:
    return items.orderBy(F.desc("rate"), "interaction_id").limit(n)
