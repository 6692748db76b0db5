"""Jobs end to end: written outputs, quarantine, resume, publication, streams."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstate.operators import bayes, catalog, compare, generate, labels, prompts, resume, states
from turnstate.plans import inputs as IN
from turnstate.plans import jobs
from turnstate.schemas import CONFIDENCE, FIELDS
from turnstate.sinks import tables
from turnstate.sources import documents
from turnstate.streaming.incremental import delta_stream, resume_stream

CLOCK = "2026-01-01T00:00:00Z"
SF = "/root/testdata/sf0.001"
TURN = "interaction_id string, context_module string, pos int, turn_number int, human_input string, ai_response string"


@pytest.fixture(scope="module")
def small(spark):
    turns = spark.createDataFrame(
        [(i, "general", n, n, text, "ok") for i in ("good", "late")
         for n, text in enumerate(["compare a and b", "you decide", "maybe compare"])]
        + [("short", "general", 0, 0, "hello", "ok"), ("bad", "travel", 0, 0, "x", "y"), ("bad", "travel", 1, 1, "x", "y")], TURN)
    turns = turns.withColumn("turn_number", F.when((F.col("interaction_id") == "late") & (F.col("pos") == 2), 1).otherwise(F.col("turn_number")))
    people = turns.select("interaction_id", "context_module", F.lit("h").alias("human_id"), F.lit("a").alias("ai_id")).distinct()
    return people, turns


def test_extraction_writes_only_whole_interactions(spark, small, rows, tmp_path):
    people, turns = small
    out = str(tmp_path / "out")
    manifest = jobs.run_extraction(people, turns, labels.rule_labels, out=out, run_id="r1", run_clock=CLOCK)
    assert rows(manifest.select("interaction_id", "status", "state_count", "delta_count", "error")) == [
        ("bad", "failed", 0, 0, "contract:context_module_unknown"), ("good", "completed", 3, 2, None),
        ("late", "failed", 0, 0, "non_increasing_turns"), ("short", "failed", 0, 0, "contract:too_few_turns")]
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    for name, count in (("states", 3), ("deltas", 2), ("overlays", 3), ("extracts", 3), ("trajectories", 1)):
        assert read(name).count() == count, name
    assert read("run_errors").count() == 3
    jobs.run_extraction(people, turns, labels.rule_labels, out=out, run_id="r1", run_clock=CLOCK)
    jobs.run_extraction(people, turns, labels.rule_labels, out=out, run_id="r2", run_clock=CLOCK)
    assert rows(read("states").groupBy("run_id").count()) == [("r1", 3), ("r2", 3)]


def test_dataset_runs_and_matrix(spark, small, rows, tmp_path):
    people, turns = small
    items = spark.createDataFrame(
        [("d", 0, "good", "s1", "train"), ("d", 1, "short", "s1", "train"), ("d", 2, "bad", "s2", "test")],
        "dataset_id string, seq int, interaction_id string, scenario_id string, split string")
    out = str(tmp_path / "m")
    done = jobs.run_matrix(
        {"a": ("heuristic_baseline", labels.rule_labels), "b": ("heuristic_baseline", labels.rule_labels)},
        items, people, turns, out=out, run_clock=CLOCK, split="train")
    assert rows(done.select("label", "interaction_id", "status")) == [
        ("a", "good", "completed"), ("a", "short", "failed"), ("b", "good", "completed"), ("b", "short", "failed")]
    log = spark.read.parquet(f"{out}/a/dataset_runs")
    assert rows(log.select("item_count", "completed_count", "failed_count", "status")) == [(2, 1, 1, "partial")]
    jobs.run_dataset(items, people, turns, labels.rule_labels, track_name="t", out=out, run_clock=CLOCK, split="none")
    assert rows(spark.read.parquet(f"{out}/dataset_runs").select("item_count", "status")) == [(0, "no_items_matched")]


def test_observer_errors_keep_all_attempts(spark, small, rows, tmp_path):
    people, turns = small
    answers = turns.select("interaction_id", "turn_number").distinct().withColumn("model_id", F.lit("m")).withColumn(
        "attempt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("response_text", F.concat(F.lit("no "), F.col("attempt")))
    track = lambda t: prompts.observer_labels(t, answers, model_id="m")
    out = str(tmp_path / "obs")
    only = lambda df: df.filter("interaction_id = 'good'")
    jobs.run_extraction(only(people), only(turns), track, out=out, run_id="r", run_clock=CLOCK)
    assert rows(spark.read.parquet(f"{out}/run_errors").select("error", "pos", "attempt_responses")) == [("invalid_json", 0, ["no 0", "no 1"])]
    assert spark.read.schema("interaction_id string").parquet(f"{out}/states").count() == 0


def test_model_tables(spark, rows, tmp_path):
    data = spark.createDataFrame([(0, "a b", *["Human", "Absent", "Active", "None"]), (1, "c", *["AI", "Absent", "Active", "None"])],
                                 "seq int, text string, " + ", ".join(f"{f} string" for f in FIELDS))
    path = str(tmp_path / "model")
    tables.write_model(bayes.train(data), path)
    model = documents.read_model(spark, path)
    texts = spark.createDataFrame([(1, "c c")], "id int, text string")
    got = bayes.score(texts, model, key=["id"]).filter("field = 'judgment_holder'").select("label")
    assert rows(got) == [("AI",)]
    part = str(tmp_path / "part")
    tables.write_model(bayes.train(data, FIELDS[:3]), part)
    with pytest.raises(Exception, match="model lacks fields: information_seeking"):
        documents.read_model(spark, part).classes.collect()


def test_catalog_log_keeps_first_created(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    cols = "run_id string, status string, created_at string, updated_at string, seq int"
    tables.append_log(spark.createDataFrame([("r", "running", "t1", "t1", 0), ("q", "failed", "t1", "t1", 0)], cols), path)
    tables.append_log(spark.createDataFrame([("r", "completed", "t2", "t2", 1)], cols), path)
    assert rows(catalog.latest(spark.read.parquet(path), ["run_id"]).select("run_id", "status", "created_at", "updated_at")) == [
        ("q", "failed", "t1", "t1"), ("r", "completed", "t1", "t2")]


def test_children_are_replaced_per_dataset(spark, rows, tmp_path):
    path = str(tmp_path / "items")
    df = lambda data: spark.createDataFrame(data, "interaction_id string, dataset_id string")
    tables.replace_children(df([("a", "d1"), ("b", "d1"), ("c", "d2")]), path)
    tables.replace_children(df([("z", "d1")]), path)
    assert rows(spark.read.parquet(path).select("dataset_id", "interaction_id")) == [("d1", "z"), ("d2", "c")]


PACK = {
    "scenario_pack_id": "p", "context_module": "general",
    "scenarios": [
        {"scenario_id": "s1", "title": "One", "context_module": "general", "slot_options": {"x": ["u", "v"]},
         "turn_templates": [{"turn_number": 0, "human_input": "ask {x}", "ai_response": "say {x}"},
                            {"turn_number": 1, "human_input_options": ["p", "q"], "ai_response": "ok"}]},
        {"scenario_id": "s2", "context_module": "general", "slot_options": {},
         "blueprints": [{"blueprint_id": "b", "turn_templates": [{"turn_number": 0, "human_input": "{gone}", "ai_response": "r"},
                                                                 {"turn_number": 1, "human_input": "h", "ai_response": "r"}]}]},
    ],
}


def test_generation_publishes_only_complete(spark, rows, tmp_path):
    path = tmp_path / "pack.json"
    path.write_text(json.dumps(PACK, indent=1))
    scenarios = documents.read_scenarios(spark, str(path))
    make = lambda sc, name, existing=None: jobs.generate_dataset(
        sc, dataset_name="n", dataset_id="k/n/v", count=3, seed=7, staging=str(tmp_path / name), target_path=str(tmp_path / "pub"), existing=existing)
    with pytest.raises(RuntimeError, match="accepted=3, target=6"):
        make(scenarios, "one")
    assert not (tmp_path / "pub").exists()
    first = spark.read.parquet(str(tmp_path / "one" / "generation_items"))
    assert rows(first.groupBy("scenario_id", "status").count()) == [("s1", "accepted", 3), ("s2", "failed", 3)]
    fixed = json.loads(json.dumps(PACK).replace("{gone}", "here"))
    path.write_text(json.dumps(fixed))
    again = make(documents.read_scenarios(spark, str(path)), "two", first)
    assert rows(again.select("scenario_id", "attempt_count").distinct()) == [("s2", 2)]
    published = spark.read.parquet(str(tmp_path / "pub"))
    assert published.count() == 6 and rows(published.groupBy("split").count()) == [("test", 2), ("train", 3), ("validation", 1)]


def test_generation_is_stable_in_blocks(spark, rows, tmp_path, monkeypatch):
    path = tmp_path / "pack.json"
    path.write_text(json.dumps(PACK))
    scenarios = documents.read_scenarios(spark, str(path)).filter("scenario_id = 's1'")
    built = lambda: rows(generate.materialise(generate.plan_items(scenarios, dataset_name="n", count=25, seed=7)).select("interaction_id", "turns"))
    whole = built()
    monkeypatch.setattr(generate, "BLOCK", 4)
    assert built() == whole and len(whole) == 25


def test_gate_fails_after_writing(spark, tmp_path):
    items = spark.createDataFrame([("i", "s", "general", "test")], "interaction_id string, scenario_id string, context_module string, split string")
    examples = spark.createDataFrame([(0, "o", "general", "AI")], "seq int, interaction_id string, context_module string, h string").withColumn(
        "hint", F.struct(F.col("h").alias("judgment_holder"))).drop("h")
    values = [("r1", "i", 0, 0, "AI", "Absent", "Active", "None"), ("r2", "i", 0, 0, "Human", "Explicit", "Passive", "Active")]
    rows_ = spark.createDataFrame(values, "run_key string, interaction_id string, turn_number int, seq int, " + ", ".join(f"{f} string" for f in FIELDS))
    result = jobs.fewshot_benchmark(items, examples, rows_, split="test", max_average=0.75, max_item=1.0)
    out = str(tmp_path / "bench")
    with pytest.raises(ValueError, match="average_field_disagreement_rate 1.0000 exceeds 0.7500"):
        jobs.write_benchmark(result, out)
    assert spark.read.parquet(f"{out}/summary").first()["zero_disagreement_items"] == 0
    assert spark.read.parquet(f"{out}/items").first()["example_count"] == 1


def test_extract_lines_round_trip(spark, small, rows, tmp_path):
    _, turns = small
    path = str(tmp_path / "lines")
    tables.write_lines(labels.extracts(labels.rule_labels(turns), stored_at=CLOCK).drop("pos"), path)
    back = documents.read_extracts(spark, path)
    assert back.count() == turns.count()
    assert rows(back.select("jsv_hint.confidence.judgment_holder").distinct()) == [("low",)]
    (tmp_path / "lines" / "broken.json").write_text('{"interaction_id": \n\n')
    with pytest.raises(Exception):
        documents.read_extracts(spark, path).collect()


def test_manifest_pack_and_summary_readers(spark, rows, tmp_path):
    item = {"interaction_id": "i", "scenario_id": "s", "scenario_title": "t", "context_module": "general", "relative_path": "p",
            "split": "train", "turn_count": 2}
    (tmp_path / "m.json").write_text(json.dumps({"dataset_id": "d", "items": [item, {**item, "interaction_id": "j", "slot_values": {"a": "1"}}]}))
    got = documents.read_manifest(spark, str(tmp_path / "m.json"))
    assert rows(got.select("seq", "interaction_id", "slot_values", "blueprint_id")) == [(0, "i", {}, None), (1, "j", {"a": "1"}, None)]
    assert rows(jobs.slice_items(got, split="train", max_items=1).select("interaction_id")) == [("i",)]
    (tmp_path / "p.json").write_text(json.dumps({"source_run_id": "r", "examples": [
        {"interaction_id": "i", "turn_number": 0, "context_module": "general", "human_input": "h", "ai_response": "a", "jsv_hint": {"judgment_holder": "AI"}}]}))
    assert rows(documents.read_example_pack(spark, str(tmp_path / "p.json")).select("pack_id", "seq", "hint.judgment_holder")) == [("r", 0, "AI")]
    (tmp_path / "s.json").write_text(json.dumps({"dataset_run_id": "x", "items": [
        {"interaction_id": "i", "status": "completed", "run_id": "1"}, {"interaction_id": "i", "status": "completed", "run_id": "2"},
        {"interaction_id": "j", "status": "failed", "run_id": "3"}]}))
    assert rows(documents.completed_items(documents.read_run_items(spark, str(tmp_path / "s.json")), ["dataset_run_id"]).select("interaction_id", "run_id")) == [("i", "2")]


def test_documents_are_replaced_by_key(spark, rows, tmp_path):
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    tables.write_documents(df([("a", 1), ("b", 1)]), str(tmp_path / "docs"), key="id")
    tables.write_documents(df([("a", 2)]), str(tmp_path / "docs"), key="id")
    assert rows(spark.read.json(str(tmp_path / "docs")).select("id", "v")) == [("a", 2), ("b", 1)]


def test_resume_stream_labels_only_new_turns(spark, small, tmp_path):
    _, turns = small
    src, stored, check = (str(tmp_path / n) for n in ("turns", "stored", "check"))
    track = lambda t: labels.rule_labels(t).select("interaction_id", "turn_number", "human_input", "ai_response", *FIELDS)
    run = lambda: resume_stream(spark, src, turns.schema, stored, track, check)
    good = turns.filter("interaction_id = 'good'")
    good.filter("pos < 2").coalesce(1).write.mode("append").parquet(src)
    run()
    changed = good.withColumn("ai_response", F.when(F.col("pos") == 1, "other").otherwise(F.col("ai_response")))
    changed.coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    per_batch = {r["batch"]: r["n"] for r in spark.read.parquet(stored).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert per_batch == {0: 2, 1: 2}


def test_delta_stream_over_batches(spark, rows, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    cols = "k string, at bigint, v string"

    def run(data):
        spark.createDataFrame(data, cols).coalesce(1).write.mode("append").parquet(src)
        stream = delta_stream(spark.readStream.schema(cols).parquet(src), key="k", key_type="string", order_by=[("at", "bigint")], value="v", ordered=["lo", "mid", "hi"])
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    run([("a", 2, "hi"), ("a", 1, "lo"), ("b", 1, "odd")])
    run([("a", 3, "mid"), ("a", 2, "lo"), ("b", 5, "hi")])
    assert rows(spark.read.parquet(out)) == [
        ("a", 1, 2, 1.0, False), ("a", 2, 2, None, True), ("a", 2, 3, -0.5, False), ("b", 1, 5, None, False)]


def test_delta_sums_telescope(spark):
    """Where the holder is never undefined, the deltas add up to the whole way."""
    rows_ = IN.hint_labels(spark, SF).filter("error is null")
    order = states.states(rows_.withColumn("pos", F.row_number().over(Window.partitionBy("interaction_id").orderBy("pos")) - 1), run_clock=CLOCK)
    total = states.deltas(order).groupBy("interaction_id").agg(F.sum("delta_cognitive_engagement").alias("s"))
    level = states._ordinal(F.col("cognitive_engagement"), ["Active", "Reactive", "Passive"])
    ends = order.groupBy("interaction_id").agg(((F.max_by(level, "pos") - F.min_by(level, "pos")) / 2).alias("w"))
    assert total.join(ends, "interaction_id").filter("s <> w").count() == 0
    assert total.count() > 5


def test_rates_stay_in_range(spark):
    items = compare.comparison_summary(compare.last_per_turn(IN.compared_labels(spark, SF)))
    assert items.filter("rate < 0 or rate > 1").count() == 0


def test_fallback_lookup(spark, rows, monkeypatch):
    t = spark.createDataFrame([("i", n) for n in range(4)] + [("j", 0)], "interaction_id string, turn_number int")
    by_key = spark.createDataFrame([("i", 0, "k0"), ("i", 3, "k3")], "interaction_id string, turn_number int, response_text string")
    by_turn = spark.createDataFrame([(0, "t0"), (2, "t2"), (3, "t3")], "turn_number int, response_text string")
    want = [("i", 0, "k0", "key"), ("i", 1, "d", "default"), ("i", 2, "t2", "turn"), ("i", 3, "k3", "key"), ("j", 0, "t0", "turn")]
    for early in (10_000, 1):
        monkeypatch.setattr(prompts, "EARLY_TURNS", early)
        got = prompts.fallback_responses(t, by_key, by_turn, "d")
        assert rows(got.select("interaction_id", "turn_number", "response_text", "response_source")) == want


def test_resume_job_and_progress(spark, small, rows):
    _, turns = small
    good = turns.filter("interaction_id = 'good'")
    stored = good.filter("pos = 0").withColumn("seq", F.lit(0))
    fresh, marked = jobs.resume_extraction(good, stored, labels.rule_labels)
    assert rows(fresh.select("turn_number")) == [(1,), (2,)]
    marked = marked.withColumn("done", F.col("pos") < 2)
    assert rows(resume.run_progress(marked)) == [("good", 3, 2, 1, 1, "running")]
    assert rows(resume.progress_turns(marked, part_turns=2)) == [("good", 0, [0], [1]), ("good", 1, [], [])]


def test_matrix_benchmark_and_report(spark, rows):
    values = [("base", "i", 0, 0, "AI", "Absent", "Active", "None"), ("base", "i", 1, 0, "AI", "Absent", "Active", "None"),
              ("x", "i", 0, 0, "Human", "Absent", "Active", "None"), ("y", "i", 1, 0, "AI", "Absent", "Active", "None"),
              ("x", "other", 0, 0, "AI", "Absent", "Active", "None"), ("y", "i", 7, 0, "AI", "Absent", "Active", "None")]
    cols = "run_key string, interaction_id string, turn_number int, seq int, " + ", ".join(f"{f} string" for f in FIELDS)
    data = spark.createDataFrame(values, cols).withColumn("confidence", F.lit(None).cast(CONFIDENCE))
    pairs, summary, ensemble = jobs.benchmark_matrix(data, baseline="base")
    assert rows(pairs.select("label", "interaction_id", "turns_compared", "rate")) == [("x", "i", 1, 0.25), ("y", "i", 1, 0.0)]
    assert rows(summary) == [("x", 1, 0.25, 0.25), ("y", 1, 0.0, 0.0)]
    assert rows(ensemble.turns.select("turn_number", "runs_missing")) == [(0, ["y"]), (1, ["x"])]
    items = ensemble.summary.withColumn("example_count", F.lit(0))
    _, fields, worst = jobs.regression_report(items)
    assert fields.first()["field"] == "judgment_holder" and worst.first()["interaction_id"] == "i"
