"""Composite jobs: the operators put together the way a user runs them.

Each job is a set of DataFrames. Jobs with several outputs write their labels first and
derive the rest from the written table, so a lost executor never repeats the labelling.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstate.functions.identity import dataset_run_id
from turnstate.operators import bayes, catalog, compare, contracts, fewshot, generate, labels, prompts, states
from turnstate.operators.quality import quality_gate
from turnstate.operators.resume import dataset_run_counts, with_stored
from turnstate.operators.splits import assign_splits
from turnstate.sinks import tables
from turnstate.sources.documents import flatten_turns, read_interactions, read_model

Track = Callable[[DataFrame], DataFrame]
RUN_TABLES = ("states", "deltas", "overlays", "extracts", "trajectories", "run_errors", "run_manifests")


@dataclass(frozen=True)
class Extraction:
    """Outputs of one track over all interactions; canonical rows exclude failed ones."""

    labels: DataFrame
    states: DataFrame
    deltas: DataFrame
    overlays: DataFrame
    errors: DataFrame
    manifest: DataFrame


def _violated(stage: str):
    return F.when(F.size("violations") > 0, F.concat(F.lit(f"{stage}:"), F.array_join("violations", ",")))


def extract(
    interactions: DataFrame, turns: DataFrame, track: Track, *, run_clock: str,
    saved: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Extraction:
    """Contract check, labels, states, deltas, each checked; an interaction with any error
    yields nothing.

    The error reported is the first of the earliest stage: input contract, track, state
    contract, delta, delta contract, continuity. States take the turn's own timestamps where
    the turns carry them. `saved` may write the labels and hand back the written table.
    """
    checked = contracts.interaction_violations(turns, interactions)
    contract_errors = checked.filter(F.size("violations") > 0).select(
        "interaction_id", F.lit(0).alias("stage"), F.lit(-1).alias("pos"),
        F.concat(F.lit("contract:"), F.array_join("violations", ",")).alias("error"),
    )
    labelled = saved(track(turns))
    given = {name: F.col(name) for name in ("meta_time", "turn_time", "extensions") if name in labelled.columns}
    state_rows = states.states(labelled, run_clock=run_clock, **given)
    delta_rows = states.deltas(state_rows)
    errors = contract_errors
    checks = [
        (state_rows, F.col("error")),
        (contracts.state_violations(state_rows), _violated("state")),
        (delta_rows, F.col("error")),
        (contracts.delta_violations(delta_rows), _violated("delta")),
        (states.continuity(delta_rows), F.concat(F.lit("trajectory:"), F.col("problem"))),
    ]
    for stage, (rows, error) in enumerate(checks, start=1):
        failing = rows.select("interaction_id", F.lit(stage).alias("stage"), "pos", error.alias("error"))
        errors = errors.unionByName(failing.filter(F.col("error").isNotNull()))
    errors = contracts.first_errors(errors)
    kept = lambda df: contracts.all_or_nothing(df, errors)
    # One aggregation over states carries both counts: every state but the first has a delta.
    counts = kept(state_rows).groupBy("interaction_id").agg(F.count(F.lit(1)).alias("state_count"))
    manifest = (
        interactions.select("interaction_id")
        .join(errors.select("interaction_id", "error"), "interaction_id", "left")
        .join(counts, "interaction_id", "left")
        .select(
            "interaction_id",
            F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"),
            F.coalesce("state_count", F.lit(0)).alias("state_count"),
            F.greatest(F.coalesce("state_count", F.lit(0)) - 1, F.lit(0)).alias("delta_count"),
            "error",
        )
    )
    return Extraction(
        labels=labelled,
        states=kept(state_rows).drop("error"),
        deltas=kept(delta_rows).drop("error"),
        overlays=labels.overlays(kept(labelled)),
        errors=errors,
        manifest=manifest,
    )


def run_extraction(
    interactions: DataFrame, turns: DataFrame, track: Track, *, out: str, run_id: str, run_clock: str,
) -> DataFrame:
    """Run one track and write every output table under `out`; returns the manifest.

    The run is committed when all its tables are there: `tables.committed_run` reads it then, and
    not while it is written, for the first time or again.
    """
    spark = interactions.sparkSession
    tables.withdraw_run(spark, out, run_id)
    tagged = lambda df: df.withColumn("run_id", F.lit(run_id))
    saved = lambda df: tables.write_table(df, f"{out}/labels/{run_id}")
    run = extract(interactions, turns, track, run_clock=run_clock, saved=saved)
    for name in ("states", "deltas", "overlays"):
        tables.write_table(tagged(getattr(run, name)), f"{out}/{name}", partitions=("run_id",))
    stored = labels.extracts(contracts.all_or_nothing(run.labels, run.errors), stored_at=run_clock)
    tables.write_table(tagged(stored), f"{out}/extracts", partitions=("track_name", "run_id"))
    tables.write_table(tagged(states.trajectories(run.deltas)), f"{out}/trajectories", partitions=("run_id",))
    answered = "attempt_responses" in run.labels.columns
    tried = run.labels.select(
        "interaction_id", "pos",
        (F.col("attempt_responses") if answered else F.array().cast("array<string>")).alias("attempt_responses"),
    )
    failures = run.errors.join(tried, ["interaction_id", "pos"], "left")
    tables.write_table(tagged(failures), f"{out}/run_errors", partitions=("run_id",))
    manifest = tables.write_table(tagged(run.manifest), f"{out}/run_manifests", partitions=("run_id",))
    tables.commit_run(spark, out, run_id, RUN_TABLES)
    return manifest


def slice_items(
    items: DataFrame, *, split: str | None = None, scenario_id: str | None = None,
    context_module: str | None = None, max_items: int | None = None,
) -> DataFrame:
    """Filtered items, then the first `max_items` in manifest order."""
    rows = catalog.matching(items, split=split, scenario_id=scenario_id, context_module=context_module)
    return rows if max_items is None else rows.orderBy("seq").limit(max_items)


def catalog_rows(items: DataFrame, *, track_name: str, dataset_run_id: str, out: str, run_clock: str) -> DataFrame:
    """One catalog row per item, `running`: what a run is known by before anything has come of it.

    `seq` is 0 here and 1 in `ended_runs`, so of two rows with one clock the end is the latest.
    """
    run_id = F.concat_ws("-", F.lit(track_name), F.col("interaction_id"))
    known = lambda name: F.col(name) if name in items.columns else F.lit(None).cast("string")
    return items.select(
        run_id.alias("run_id"), "interaction_id", known("dataset_id").alias("dataset_id"),
        F.lit(dataset_run_id).alias("dataset_run_id"), F.lit(track_name).alias("track_name"),
        known("relative_path").alias("input_path"), F.concat(F.lit(f"{out}/runs/"), run_id).alias("run_dir"),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.lit(run_clock).alias("created_at"), F.lit(run_clock).alias("updated_at"), F.lit(0).cast("bigint").alias("seq"),
    )


def ended_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """The catalog rows of runs with how they ended: (interaction_id, status, error_message)."""
    rows = runs.drop("status", "error_message").join(ended, "interaction_id")
    return rows.withColumn("seq", F.col("seq") + 1).select(*runs.columns)


def run_dataset(
    items: DataFrame, interactions: DataFrame, turns: DataFrame, track: Track, *, track_name: str,
    out: str, run_clock: str, split: str | None = None, scenario_id: str | None = None,
    max_items: int | None = None,
) -> DataFrame:
    """Extract one slice of a dataset; one row per item and the run's counts in the log."""
    spark = items.sparkSession
    chosen = slice_items(items, split=split, scenario_id=scenario_id, max_items=max_items)
    ids = chosen.select("interaction_id")
    text = lambda v: F.lit(v).cast("string")
    identity = dataset_run_id(text(out), text(track_name), text(split), text(scenario_id), text(max_items))
    run_id = spark.range(1).select(identity.alias("id")).first()["id"]
    runs = catalog_rows(chosen, track_name=track_name, dataset_run_id=run_id, out=out, run_clock=run_clock)
    tables.append_log(runs, f"{out}/runs")
    manifest = run_extraction(
        interactions.join(ids, "interaction_id", "left_semi"),
        turns.join(ids, "interaction_id", "left_semi"),
        track, out=out, run_id=run_id, run_clock=run_clock,
    ).filter(F.col("run_id") == run_id)
    rows = chosen.join(manifest.drop("run_id"), "interaction_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("failed"))
    ).withColumn("dataset_run_id", F.lit(run_id)).withColumn("track_name", F.lit(track_name))
    stored = tables.write_table(rows, f"{out}/run_items", partitions=("dataset_run_id",))
    ended = stored.filter(F.col("dataset_run_id") == run_id).select(
        "interaction_id", "status", F.coalesce("error", F.when(F.col("status") == "failed", "not_extracted")).alias("error_message")
    )
    tables.append_log(ended_runs(runs, ended), f"{out}/runs")
    counts = dataset_run_counts(stored.filter(F.col("dataset_run_id") == run_id), ["dataset_run_id"])
    empty = spark.range(1).select(
        F.lit(run_id).alias("dataset_run_id"), F.lit(0).cast("bigint").alias("item_count"),
        F.lit(0).cast("bigint").alias("completed_count"), F.lit(0).cast("bigint").alias("failed_count"),
        F.lit("no_items_matched").alias("status"),
    )
    row = counts.unionByName(empty.join(counts, "dataset_run_id", "left_anti"))
    logged = row.select(
        "*", F.lit(track_name).alias("track_name"), text(split).alias("split"),
        text(scenario_id).alias("scenario_id"), F.lit(run_clock).alias("created_at"),
        F.lit(run_clock).alias("updated_at"), F.lit(0).cast("bigint").alias("seq"),
    )
    tables.append_log(logged, f"{out}/dataset_runs")
    return stored.filter(F.col("dataset_run_id") == run_id)


def matrix_plan(items: DataFrame, configs: Sequence[tuple[str, str, Mapping[str, str]]]) -> DataFrame:
    """Each item once per run configuration; the few configurations are literals."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    params = lambda p: F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) if p else empty
    rows = [
        F.struct(F.lit(label).alias("label"), F.lit(track).alias("track_name"), params(p).alias("params"))
        for label, track, p in configs
    ]
    return items.withColumn("_c", F.explode(F.array(*rows))).select("*", "_c.*").drop("_c")


def run_matrix(
    tracks: Mapping[str, tuple[str, Track]], items: DataFrame, interactions: DataFrame, turns: DataFrame, *,
    out: str, run_clock: str, **slice_filters,
) -> DataFrame:
    """Run several labelled tracks over one slice; union of their item rows."""
    rows = None
    for label, (name, track) in tracks.items():
        done = run_dataset(
            items, interactions, turns, track, track_name=name, out=f"{out}/{label}",
            run_clock=run_clock, **slice_filters,
        ).withColumn("label", F.lit(label))
        rows = done if rows is None else rows.unionByName(done, allowMissingColumns=True)
    return rows


# Between a label and an interaction id in the key of a run of several tracks.
LABEL_MARK = "\u001f"


def extract_together(
    interactions: DataFrame, turns: DataFrame, tracks: Mapping[str, Callable[..., DataFrame]], *, run_clock: str,
    saved: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Extraction:
    """`extract` of several tracks at once; every output has the column `label`.

    The turns are read once and labelled in one projection (`labels.together`); a label and an
    interaction make up the key of everything after it, so all tracks share one shuffle.
    """
    keyed = lambda df: df.withColumn("interaction_id", F.concat("label", F.lit(LABEL_MARK), "interaction_id")).drop("label")
    people = interactions.withColumn("label", F.explode(F.array(*[F.lit(label) for label in tracks])))
    run = extract(keyed(people), keyed(labels.together(turns, tracks)), lambda rows: rows, run_clock=run_clock, saved=saved)
    label = F.substring_index("interaction_id", LABEL_MARK, 1)
    whole = F.expr(f"substring(interaction_id, length(label) + {len(LABEL_MARK)} + 1)")
    apart = lambda df: df.withColumn("label", label).withColumn("interaction_id", whole)
    return Extraction(*[apart(getattr(run, name)) for name in Extraction.__dataclass_fields__])


def run_matrix_together(
    tracks: Mapping[str, Callable[..., DataFrame]], items: DataFrame, interactions: DataFrame, turns: DataFrame, *,
    out: str, run_id: str, run_clock: str, **slice_filters,
) -> DataFrame:
    """Run labelled tracks over one slice in one pass; item rows of all labels.

    Every table under `out` is divided by `label` and `run_id`; the run is committed as a whole.
    """
    spark = items.sparkSession
    chosen = slice_items(items, **slice_filters)
    ids = chosen.select("interaction_id")
    tables.withdraw_run(spark, out, run_id)
    saved = lambda df: tables.write_table(df, f"{out}/labels/{run_id}")
    run = extract_together(
        interactions.join(ids, "interaction_id", "left_semi"), turns.join(ids, "interaction_id", "left_semi"), tracks,
        run_clock=run_clock, saved=saved,
    )
    written = {"states": run.states, "deltas": run.deltas, "overlays": run.overlays, "run_errors": run.errors, "run_manifests": run.manifest}
    for name, df in written.items():
        stored = tables.write_table(df.withColumn("run_id", F.lit(run_id)), f"{out}/{name}", partitions=("label", "run_id"))
    tables.commit_run(spark, out, run_id, list(written))
    every = chosen.withColumn("label", F.explode(F.array(*[F.lit(label) for label in tracks])))
    ended = stored.filter(F.col("run_id") == run_id).drop("run_id")
    return every.join(ended, ["label", "interaction_id"], "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def comparison_labels(extract_rows: DataFrame, run_key: str = "run_key") -> DataFrame:
    """Stored extracts in comparison layout. The run is part of every key."""
    seq = F.col("seq") if "seq" in extract_rows.columns else F.lit(0)
    return extract_rows.select(
        F.col(run_key).alias("run_key"), "interaction_id", "turn_number", seq.alias("seq"), "jsv_hint.*"
    )


@dataclass(frozen=True)
class Comparison:
    turns: DataFrame
    skipped: DataFrame
    summary: DataFrame


def compare_runs(label_rows: DataFrame, runs: Sequence[str] | None = None) -> Comparison:
    """Compare all runs of each interaction."""
    last = compare.last_per_turn(label_rows)
    turns = compare.turn_comparisons(last, runs)
    return Comparison(
        turns=compare.comparable(turns),
        skipped=turns.filter(F.col("present") < 2).select("interaction_id", "turn_number", "runs_missing"),
        summary=compare.comparison_summary(last),
    )


def benchmark_matrix(label_rows: DataFrame, *, baseline: str) -> tuple[DataFrame, DataFrame, Comparison]:
    """Pair rates against the baseline, their summary per label, and the ensemble of all
    labels, computed once per interaction. `label_rows` carry `label` as their run key.

    Where they also carry `run_dir`, labels that point at one run of an interaction count once
    in the ensemble, the baseline's name first, and interactions without the baseline are left
    out of it. An unknown baseline is an error.
    """
    last = compare.last_per_turn(label_rows).withColumn("label", F.col("run_key"))
    if not last.filter(F.col("label") == baseline).limit(1).count():
        raise ValueError(f"baseline {baseline!r} has no labels")
    pairs = compare.pairwise_against_baseline(last, baseline)
    ensemble = label_rows
    if "run_dir" in label_rows.columns:
        runs = label_rows.groupBy("interaction_id", "run_dir").agg(
            F.min(F.struct((F.col("run_key") != baseline).alias("later"), "run_key")).alias("_run")
        )
        based = label_rows.filter(F.col("run_key") == baseline).select("interaction_id").distinct()
        chosen = runs.select("interaction_id", "run_dir", F.col("_run.run_key").alias("run_key"))
        ensemble = label_rows.join(chosen, ["interaction_id", "run_dir", "run_key"], "left_semi").join(
            based, "interaction_id", "left_semi"
        )
    return pairs, compare.matrix_summary(pairs, last, baseline), compare_runs(ensemble)


@dataclass(frozen=True)
class FewshotBenchmark:
    plan: DataFrame
    items: DataFrame
    breakdown: DataFrame
    summary: DataFrame
    gates: DataFrame


def fewshot_benchmark(
    items: DataFrame, examples: DataFrame, label_rows: DataFrame, *, split: str, max_examples: int = 3,
    max_average: float | None = None, max_item: float | None = None,
) -> FewshotBenchmark:
    """Plan the examples of a split, compare the two runs of its items, and gate the rates."""
    targets = catalog.matching(items, split=split)
    plan = fewshot.select_examples(targets, examples, max_examples=max_examples)
    summary = compare.comparison_summary(compare.last_per_turn(label_rows))
    rated = plan.join(summary, "interaction_id")
    overall = compare.benchmark_summary(rated)
    return FewshotBenchmark(
        plan=plan,
        items=rated,
        breakdown=compare.rate_breakdown(rated, ["scenario_id", "context_module"]),
        summary=overall,
        gates=compare.threshold_gate(overall, max_average=max_average, max_item=max_item),
    )


def write_benchmark(result: FewshotBenchmark, out: str) -> None:
    """Write all results first, then fail if a gate did not pass."""
    items = tables.write_table(result.items, f"{out}/items")
    tables.write_table(compare.rate_breakdown(items, ["scenario_id", "context_module"]), f"{out}/breakdown")
    tables.write_table(result.summary, f"{out}/summary")
    gates = tables.write_table(result.gates, f"{out}/gates")
    # At most two rows: one per limit.
    failed = [r for r in gates.filter(~F.col("passed")).orderBy("metric").collect()]
    if failed:
        raise ValueError("; ".join(f"{r['metric']} {r['value']:.4f} exceeds {r['limit']:.4f}" for r in failed))


def generate_dataset(
    scenarios: DataFrame, *, dataset_name: str, dataset_id: str, count: int, seed: int, staging: str,
    target_path: str, existing: DataFrame | None = None, gate: bool = False,
    train: float = 0.6, validation: float = 0.2, rewrite: Track | None = None,
) -> DataFrame:
    """Build the items not accepted yet, log every attempt, publish when complete.

    Attempts go to an append-only log in `staging`, their turns included, so a rerun in the
    same folder goes on from it; `existing` adds the items of other folders. The latest attempt
    of an item counts. A complete dataset is published with its turns as a new version.
    `rewrite` may replace the texts of built items; with `gate` the quality reasons reject.
    Returns the items of this attempt.
    """
    spark = scenarios.sparkSession
    plan = generate.plan_items(scenarios, dataset_name=dataset_name, count=count, seed=seed)
    target = scenarios.count() * count
    log = f"{staging}/items_log"
    earlier = tables.read_log(spark, log)
    if existing is not None:
        earlier = existing if earlier is None else earlier.unionByName(existing, allowMissingColumns=True)
    existing = None if earlier is None else generate.latest_attempts(earlier)
    pending = generate.pending_items(plan, existing) if existing is not None else plan
    built = generate.materialise(pending)
    built = rewrite(built) if rewrite else built
    built = tables.write_table(built, f"{staging}/built")
    reasons = None
    if gate:
        turns = built.select("interaction_id", F.posexplode("turns").alias("pos", "t")).select(
            "interaction_id", "pos", "t.human_input", "t.ai_response",
            F.col("t.meta.jsv_hint.judgment_holder").alias("holder"),
        )
        reasons = quality_gate(turns, built)
    items = generate.generation_items(built, reasons).join(built.select("item_id", "turns"), "item_id")
    items = tables.write_table(items, f"{staging}/generation_items")
    # The log is read again only after this attempt is in it.
    state = items if existing is None else generate.latest_attempts(items.unionByName(existing, allowMissingColumns=True))
    state = tables.write_table(state, f"{staging}/state")
    tables.append_log(items, log)
    manifest = assign_splits(
        state.filter(generate.is_accepted()), seed=seed + 1, train=train, validation=validation
    ).withColumn("dataset_id", F.lit(dataset_id))
    tables.publish_if_complete(
        spark, manifest, staging=f"{staging}/manifest", target_path=target_path, target_count=target
    )
    return items


def observer_job(turns: DataFrame, responses: DataFrame, *, model_id: str) -> tuple[DataFrame, DataFrame]:
    """Labels from recorded responses, and the prompts still to be answered."""
    prompted = prompts.with_history(turns).withColumn("prompt", prompts.observer_prompt())
    resolved = prompts.first_valid_attempt(responses.filter(F.col("model_id") == model_id))
    return (
        prompts.observer_labels(turns, responses, model_id=model_id),
        prompts.repair_worklist(prompted, resolved),
    )


def train_bayes(examples: DataFrame, path: str, *, classes: Mapping[str, Sequence[str]] = bayes.LABEL_CLASSES) -> bayes.Scoring:
    """Train, store the model, and store it once more laid out for scoring."""
    # The counts are the model's token table: they are written once, where it is read from.
    saved = lambda counts: tables.write_table(counts, f"{path}/model/tokens")
    tables.write_model(bayes.train(examples, list(classes), saved=saved), f"{path}/model", tokens=False)
    model = read_model(examples.sparkSession, f"{path}/model", fields=list(classes))
    return tables.write_scoring(bayes.prepare(model, classes), f"{path}/scoring")


def resume_extraction(turns: DataFrame, stored: DataFrame, track: Track) -> tuple[DataFrame, DataFrame]:
    """New labels for turns that cannot reuse a stored one, and the turns marked."""
    marked = with_stored(turns, stored)
    return track(marked.filter(~F.col("reusable")).drop("reusable")), marked


def resume_run(turns: DataFrame, stored: DataFrame, track: Track) -> DataFrame:
    """The labels of the whole run: stored ones where the texts are unchanged, new ones elsewhere.

    `stored` has the label columns of the track besides the texts and `seq`; of several stored
    rows of a turn the last one counts.
    """
    fresh, marked = resume_extraction(turns, stored, track)
    key = ["interaction_id", "turn_number"]
    rest = [c for c in fresh.columns if c not in key]
    last = stored.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    kept = last.join(marked.filter("reusable").select(*key), key, "left_semi").select(*key, "_last.*")
    return fresh.unionByName(kept.select(*fresh.columns))


def regression_report(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overall figures, the fields and the items with the highest rates."""
    summary = compare.benchmark_summary(items)
    return summary, compare.top_fields(summary), compare.top_items(items)


def load_turns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Interactions and flat turns of a folder of documents."""
    docs = read_interactions(spark, path)
    flat = docs.select("interaction_id", "context_module", "participants.human_id", "participants.ai_id")
    return flat, flatten_turns(docs)
