"""Evaluation of labels against a reference run, and checks over stored labels and runs.

Label rows are those of `operators.compare`: run_key, interaction_id, turn_number, the four
labels and `confidence`, one row per run and turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstate.operators.compare import TURN_KEY
from turnstate.operators.splits import assign_splits
from turnstate.schemas import FIELDS, ORDINAL_VALUES, allowed_values

# Weight of a vote by its confidence level; an absent level counts as medium.
VOTE_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
# Chances of a Poisson(1) count above 0, 1, 2 ..., as the share of 256 hash values below.
POISSON_STEPS = (94, 188, 235, 251, 255)
# Label pairs that contradict each other.
CONTRADICTIONS = [(("judgment_holder", "AI"), ("delegation_awareness", "Absent"))]


def against(labels: DataFrame, truth: str) -> DataFrame:
    """Every other run's labels with the reference run's (`true_*`) of the same turn."""
    base = labels.filter(F.col("run_key") == truth).select(*TURN_KEY, *[F.col(f).alias(f"true_{f}") for f in FIELDS])
    others = labels.filter(F.col("run_key") != truth)
    return others.select("run_key", *TURN_KEY, *FIELDS).join(base, TURN_KEY)


def _same(field: str) -> Column:
    return F.col(field).eqNullSafe(F.col(f"true_{field}")).cast("int")


def accuracy(labels: DataFrame, truth: str) -> DataFrame:
    """Turns, share of equal labels per field and their mean, per run."""
    rows = against(labels, truth).groupBy("run_key").agg(
        F.count(F.lit(1)).alias("turns"), *[F.avg(_same(f)).alias(f"accuracy_{f}") for f in FIELDS]
    )
    mean = sum((F.col(f"accuracy_{f}") for f in FIELDS), F.lit(0.0)) / len(FIELDS)
    return rows.withColumn("accuracy", mean)


def confusion(labels: DataFrame, truth: str) -> DataFrame:
    """Turns per run, field, true and found label; a bounded table per run."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"true_{f}").alias("true_label"), F.col(f).alias("label")) for f in FIELDS
    ])
    return (
        against(labels, truth).select("run_key", F.explode(pairs).alias("p"))
        .groupBy("run_key", "p.field", "p.true_label", "p.label").agg(F.count(F.lit(1)).alias("turns"))
    )


def kappa(matrix: DataFrame) -> DataFrame:
    """Observed and chance agreement and Cohen's kappa per run and field; kappa is 1 where
    chance alone agrees always."""
    key = ["run_key", "field"]
    rows = matrix.groupBy(*key, "true_label").agg(F.sum("turns").alias("a"))
    columns = matrix.groupBy(*key, "label").agg(F.sum("turns").alias("b"))
    chance = rows.join(columns.withColumnRenamed("label", "true_label"), [*key, "true_label"]).groupBy(*key).agg(
        F.sum(F.col("a").cast("double") * F.col("b")).alias("_chance")
    )
    total = matrix.groupBy(*key).agg(
        F.sum("turns").alias("turns"),
        F.sum(F.when(F.col("true_label") == F.col("label"), F.col("turns")).otherwise(0)).alias("_same"),
    )
    return total.join(chance, key, "left").select(
        *key, "turns", (F.col("_same") / F.col("turns")).alias("observed"),
        (F.coalesce("_chance", F.lit(0.0)) / F.col("turns") / F.col("turns")).alias("expected"),
    ).withColumn(
        "kappa",
        F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))),
    )


def bootstrap(labels: DataFrame, truth: str, *, resamples: int = 40) -> DataFrame:
    """Accuracy per run with a 95 % interval over resampled interactions.

    An interaction's weight in a resample is a Poisson count from a hash of both, so nothing is
    drawn and nothing is copied between machines: turns are first combined per interaction,
    and the resamples of a row are combined before they are shuffled.
    """
    same = sum((_same(f) for f in FIELDS), F.lit(0))
    items = against(labels, truth).groupBy("run_key", "interaction_id").agg(
        F.sum(same).alias("same"), (F.count(F.lit(1)) * len(FIELDS)).alias("all")
    )
    drawn = items.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    digest = F.md5(F.concat_ws(":", F.lit("resample"), "resample", "interaction_id").cast("binary"))
    place = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    weight = sum(((place >= step).cast("int") for step in POISSON_STEPS), F.lit(0))
    rates = drawn.groupBy("run_key", "resample").agg(
        F.sum(F.col("same") * weight).alias("same"), F.sum(F.col("all") * weight).alias("all")
    ).filter(F.col("all") > 0)
    ends = rates.groupBy("run_key").agg(
        F.percentile(F.col("same") / F.col("all"), 0.025).alias("low"), F.percentile(F.col("same") / F.col("all"), 0.975).alias("high")
    )
    whole = items.groupBy("run_key").agg((F.sum("same") / F.sum("all")).alias("accuracy"))
    return whole.join(ends, "run_key", "left")


def weighted_vote(labels: DataFrame) -> DataFrame:
    """Label per turn and field with the largest sum of confidence weights; a tie goes to the
    first in alphabetical order. One aggregation: a sum per label value."""
    def weight(field: str) -> Column:
        level = F.coalesce(F.col("confidence")[field], F.lit("medium"))
        return sum((F.when(level == l, w).otherwise(0) for l, w in VOTE_WEIGHTS.items()), F.lit(0))

    def sums(field: str) -> list[Column]:
        return [F.sum(F.when(F.col(field) == v, weight(field)).otherwise(0)).alias(f"{field}_{v}") for v in allowed_values(field)]

    def winner(field: str) -> Column:
        ordered = sorted(allowed_values(field), reverse=True)
        votes = [F.struct(F.col(f"{field}_{v}").alias("sum"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(ordered)]
        best = F.array_max(F.array(*votes))
        return F.when(best["sum"] > 0, best["v"]).alias(field)

    votes = labels.groupBy(*TURN_KEY).agg(*[c for f in FIELDS for c in sums(f)])
    return votes.select(*TURN_KEY, *[winner(f) for f in FIELDS])


def ordinal_distance(labels: DataFrame, truth: str) -> DataFrame:
    """Mean distance on the ordinal scales (0 to 1) per run and field, over the turns where both
    labels have a place on the scale."""
    def distance(field: str) -> Column:
        scale = F.array(*[F.lit(v) for v in ORDINAL_VALUES[field]])
        a, b = (F.nullif(F.array_position(scale, c), F.lit(0)) for c in (F.col(field), F.col(f"true_{field}")))
        return F.abs(a - b) / (len(ORDINAL_VALUES[field]) - 1)

    return against(labels, truth).groupBy("run_key").agg(*[F.avg(distance(f)).alias(f"distance_{f}") for f in FIELDS])


def leaderboard(scores: DataFrame) -> DataFrame:
    """Runs by accuracy, best first; equal ones share a rank. One row per run."""
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.desc("accuracy"))))


def stuck_runs(runs: DataFrame, *, now: str, older_than_days: int) -> DataFrame:
    """Runs that still count as running and were last written longer ago than the limit."""
    age = F.datediff(F.to_date(F.substring(F.lit(now), 1, 10)), F.to_date(F.substring("updated_at", 1, 10)))
    return runs.filter((F.col("status") == "running") & (age > older_than_days)).withColumn("age_days", age)


def contradictions(labels: DataFrame, pairs: Sequence = CONTRADICTIONS) -> DataFrame:
    """Label rows that hold both labels of a contradicting pair, once per pair."""
    found = F.array_compact(F.array(*[
        F.when((F.col(a) == x) & (F.col(b) == y), F.lit(f"{a}={x},{b}={y}")) for (a, x), (b, y) in pairs
    ]))
    return labels.withColumn("contradiction", F.explode(found))


def training_rows(extracts: DataFrame, *, seed: int) -> DataFrame:
    """Text, labels and split of stored extracts. An interaction is in one split as a whole."""
    splits = assign_splits(extracts.select("interaction_id").distinct(), seed=seed)
    rows = extracts.select(
        "interaction_id", "turn_number", F.concat_ws(" ", "human_input", "ai_response").alias("text"), *[F.col("jsv_hint")[f].alias(f) for f in FIELDS]
    )
    return rows.join(splits, "interaction_id")
