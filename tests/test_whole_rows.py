"""Rows that must not be lost: null keys and turns, unlisted labels, late attempts; first causes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.operators import bayes, contracts, prompts, splits
from turnstate.operators.labels import hint_labels
from turnstate.plans import jobs
from turnstate.schemas import FIELDS, HINT

LABEL = {"judgment_holder": "Human", "delegation_awareness": "Explicit", "cognitive_engagement": "Active", "information_seeking": "Active"}


def test_turns_without_a_number_take_the_default(spark):
    turns = spark.createDataFrame([("a", 0), ("a", None), ("b", 20_000)], "interaction_id string, turn_number int")
    keyed = spark.createDataFrame([("x", 0, "keyed")], "interaction_id string, turn_number int, response_text string")
    by_turn = spark.createDataFrame([(0, "zero"), (20_000, "late")], "turn_number int, response_text string")
    rows = prompts.fallback_responses(turns, keyed, by_turn, "none").collect()
    assert sorted((r["response_text"], r["response_source"]) for r in rows) == [("late", "turn"), ("none", "default"), ("zero", "turn")]


@pytest.mark.parametrize("keys", [["a", None, "b"], [None, None, None], [None]])
def test_items_without_a_key_are_split_too(spark, keys):
    items = spark.createDataFrame([(k,) for k in keys], "interaction_id string")
    found = [r["split"] for r in splits.assign_splits(items, seed=1).collect()]
    train, validation = int(len(keys) * 0.6), int(len(keys) * 0.2)
    assert (found.count("train"), found.count("validation"), len(found)) == (train, validation, len(keys))


def test_splits_equal_a_plain_ranking(spark):
    items = spark.range(5000).select(F.concat(F.lit("i-"), "id").alias("interaction_id"))
    import hashlib

    order = sorted((r[0] for r in items.collect()), key=lambda i: (hashlib.md5(f"4:{i}".encode()).hexdigest(), i))
    wanted = {i: "train" if k < 3000 else "validation" if k < 4000 else "test" for k, i in enumerate(order)}
    rows = splits.assign_splits(items, seed=4)
    assert {r[0]: r[1] for r in rows.collect()} == wanted
    assert "BroadcastNestedLoopJoin" not in rows._jdf.queryExecution().toString()


def test_a_label_that_is_not_listed_is_scored(spark):
    examples = spark.createDataFrame([(1, "z z z", "Weird"), (2, "a b", "Human"), (3, "a c", "Human")], "seq int, text string, judgment_holder string")
    model = bayes.train(examples, ["judgment_holder"])
    found = bayes.score(spark.createDataFrame([(1, "z z")], "id int, text string"), model, key=["id"], classes={"judgment_holder": ["Human"]})
    assert [r["label"] for r in found.collect()] == ["Weird"]


def test_attempts_may_start_anywhere_and_have_gaps(spark):
    good = '{"judgment_holder":"Human","delegation_awareness":"Explicit","cognitive_engagement":"Active","information_seeking":"Active",' \
        '"confidence":{"judgment_holder":"high","delegation_awareness":"high","cognitive_engagement":"high","information_seeking":"high"},' \
        '"evidence_spans":[{"text":"t","category":"c"}],"observer_notes":""}'
    log = [("m", "a", 0, k, good if k == 4 else "bad") for k in (1, 2, 3, 4)] + [("m", "b", 0, k, "bad") for k in (1, 5, 5)]
    schema = "model_id string, interaction_id string, turn_number int, attempt int, response_text string"
    rows = {r["interaction_id"]: r for r in prompts.first_valid_attempt(spark.createDataFrame(log, schema)).collect()}
    assert rows["a"]["error"] is None and rows["a"]["attempt"] == 3
    assert rows["b"]["next_attempt"] == 6 and len(rows["b"]["tried"]) == 2


def hinted(spark, rows):
    schema = T.StructType([
        T.StructField("interaction_id", T.StringType()), T.StructField("context_module", T.StringType()), T.StructField("pos", T.IntegerType()),
        T.StructField("turn_number", T.IntegerType()), T.StructField("human_input", T.StringType()), T.StructField("ai_response", T.StringType()),
        T.StructField("hint", HINT), T.StructField("turn_time", T.StringType()), T.StructField("meta_time", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)


def test_the_first_cause_is_reported_and_times_are_kept(spark):
    clock, own = "2026-01-01T00:00:00Z", "2025-05-05T05:05:05Z"
    hint = {**LABEL, "confidence": None, "extensions": None}
    rows = [(i, "general", p, p, "human", "reply", None if (i, p) == ("gap", 1) else hint, own, "") for i in ("gap", "whole") for p in range(3)]
    rows += [("bare", "education", p, p, "human", "reply", hint, "yesterday", None) for p in range(2)]
    people = spark.createDataFrame([(i, "general", "h", "a") for i in ("gap", "whole")] + [("bare", "education", "h", "a")], "interaction_id string, context_module string, human_id string, ai_id string")
    run = jobs.extract(people, hinted(spark, rows), hint_labels, run_clock=clock)
    errors = {r["interaction_id"]: (r["error"], r["pos"]) for r in run.errors.collect()}
    assert errors == {"gap": ("missing_hint", 1), "bare": ("state:timestamp_invalid,extensions_missing", 0)}
    assert {(r["interaction_id"], r["timestamp"]) for r in run.states.collect()} == {("whole", own)}


def test_matrix_lists_labels_apart_and_counts_runs_once(spark):
    rows = [(k, i, 0, 0, *LABEL.values(), None, f"/runs/{d}/{i}") for k, i, d in (
        ("base", "a", "one"), ("same", "a", "one"), ("other", "a", "two"), ("apart", "z", "three"),
    )]
    schema = "run_key string, interaction_id string, turn_number int, seq int, " + ", ".join(f"{f} string" for f in FIELDS)
    schema += ", confidence struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">, run_dir string"
    data = spark.createDataFrame(rows, schema)
    _, summary, ensemble = jobs.benchmark_matrix(data, baseline="base")
    assert {r["label"]: (r["item_count"], r["average_rate"]) for r in summary.collect()} == {"same": (1, 0.0), "other": (1, 0.0), "apart": (0, 0.0)}
    assert [(r["interaction_id"], r["present"]) for r in ensemble.turns.collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="baseline"):
        jobs.benchmark_matrix(data, baseline="nobody")


def test_first_errors_without_stages_follow_the_turns(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "interaction_id string, pos int, error string")
    assert [(r["error"], r["pos"]) for r in contracts.first_errors(rows).collect()] == [("early", 1)]


def test_a_dataset_is_rerun_in_its_folder_and_published_with_its_turns(spark, tmp_path):
    import json

    from turnstate.sinks.tables import published
    from turnstate.sources import documents

    turn = lambda k, text: {"turn_number": k, "human_input": text, "ai_response": "reply {x}"}
    pack = lambda name: {
        "pack_id": "p", "scenarios": [
            {"scenario_id": s, "title": s, "context_module": "general", "slot_options": {"x": ["1", "2"]}, "turn_templates": [turn(0, "start {x}"), turn(1, f"go {{{name if s == 's2' else 'x'}}}")]}
            for s in ("s1", "s2")
        ],
    }
    path = tmp_path / "pack.json"

    def make(name):
        path.write_text(json.dumps(pack(name)))
        return jobs.generate_dataset(
            documents.read_scenarios(spark, str(path)), dataset_name="n", dataset_id="d", count=3, seed=7,
            staging=str(tmp_path / "staging"), target_path=str(tmp_path / "pub"),
        )

    with pytest.raises(RuntimeError, match="accepted=3, target=6"):
        make("gone")
    assert {r["scenario_id"] for r in make("x").collect()} == {"s2"}
    assert make("x").count() == 0
    found = published(spark, str(tmp_path / "pub"))
    assert found.count() == 6 and all(len(r["turns"]) == 2 for r in found.collect())
    assert spark.read.parquet(str(tmp_path / "pub")).count() == 12


def test_a_resumed_run_is_whole(spark):
    from turnstate.operators.labels import rule_labels

    turns = lambda reply: spark.createDataFrame(
        [("a", "general", k, k, "compare options", reply if k == 1 else "r") for k in range(3)],
        "interaction_id string, context_module string, pos int, turn_number int, human_input string, ai_response string",
    )
    stored = rule_labels(turns("old")).withColumn("observer_notes", F.lit("stored")).withColumn("seq", F.lit(0))
    rows = jobs.resume_run(turns("new"), stored, rule_labels).collect()
    assert sorted((r["pos"], r["ai_response"], r["observer_notes"] == "stored") for r in rows) == [(0, "r", True), (1, "new", False), (2, "r", True)]


def test_targets_choose_from_their_own_pack(spark):
    from turnstate.operators.fewshot import select_examples

    examples = spark.createDataFrame(
        [(p, s, f"{p}{s}", 0, "general", h) for p in ("p", "q") for s, h in enumerate(["AI", "Human", "Shared"])],
        "pack_id string, seq int, interaction_id string, turn_number int, context_module string, holder string",
    ).withColumn("hint", F.struct(F.col("holder").alias("judgment_holder"))).drop("holder")
    targets = spark.createDataFrame([("t", "general", "p"), ("q0", "general", "q"), ("u", "general", "none")], "interaction_id string, context_module string, pack_id string")
    found = {r["interaction_id"]: [e["interaction_id"] for e in r["examples"]] for r in select_examples(targets, examples, max_examples=2).collect()}
    assert found == {"t": ["p0", "p1"], "q0": ["q1", "q2"], "u": []}
    either = select_examples(targets.drop("pack_id"), examples, max_examples=2).collect()
    assert [e["interaction_id"] for r in either if r["interaction_id"] == "t" for e in r["examples"]] == ["p0", "p1"]
