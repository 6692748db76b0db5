"""Hand-derived results of single operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from turnstate.functions import identity, responses
from turnstate.functions.text import strip, tokens
from turnstate.operators import bayes, catalog, compare, contracts, fewshot, generate, labels, prompts, resume, splits, states
from turnstate.operators.quality import quality_gate
from turnstate.plans import jobs
from turnstate.schemas import FIELDS
from turnstate.sources.documents import flatten_turns, read_interactions

G1 = [
    "Should I accept the lab's offer?",
    "Please compare pay and location.",
    "Not sure, so what would you choose?",
    "Maybe I will decide after checking alternatives.",
]
CLOCK = "2026-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(
        [("i", "general", n, n, text, "ok") for n, text in enumerate(G1)],
        "interaction_id string, context_module string, pos int, turn_number int, human_input string, ai_response string",
    )


@pytest.fixture(scope="module")
def ruled(turns):
    return labels.rule_labels(turns)


def test_phrase_rules(ruled, rows):
    got = ruled.select(
        "pos", *FIELDS, "observer_confidence", F.transform("evidence_spans", lambda s: s["category"])
    )
    assert rows(got) == [
        (0, "Undefined", "Absent", "Passive", "None", 0.68, ["default_excerpt"]),
        (1, "Shared", "Explicit", "Active", "Active", 0.76, ["exploration_signal"]),
        (2, "AI", "Explicit", "Reactive", "Passive", 0.82, ["delegation_signal"]),
        (3, "Human", "Explicit", "Reactive", "Passive", 0.82,
         ["exploration_signal", "retention_signal", "hedging_signal"]),
    ]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_deltas(ruled, rows, chunk):
    got = states.deltas(states.states(ruled, run_clock=CLOCK), chunk_rows=chunk)
    assert rows(got.select("from_turn", "to_turn", *[f"delta_{f}" for f in FIELDS], "error")) == [
        (0, 1, None, -1.0, -1.0, -1.0, None), (1, 2, 0.5, 0.0, 0.5, 0.5, None), (2, 3, -1.0, 0.0, 0.0, 0.0, None),
    ]


def test_delta_errors(spark, rows):
    df = spark.createDataFrame(
        [("a", 0, 0, "Undefined", "Absent", "Active", "None"), ("a", 1, 0, "Human", "Absent", "Active", "None"),
         ("a", 2, 3, "Robot", "Absent", "Active", "None"), ("a", 3, 4, "Undefined", "Odd", "Active", "None")],
        "interaction_id string, pos int, turn_number int, " + ", ".join(f"{f} string" for f in FIELDS),
    ).withColumn("context_module", F.lit(None).cast("string"))
    got = states.deltas(df).select("to_turn", "context_module", "error")
    assert rows(got) == [
        (0, "general", "non_increasing_turns"), (3, "general", "invalid_transition_judgment_holder"),
        (4, "general", "invalid_transition_delegation_awareness"),
    ]


@pytest.fixture(scope="module")
def two_runs(spark, ruled):
    silver = [("Human", "Explicit", "Active", "Active"), ("Shared", "Explicit", "Active", "Active"),
              ("AI", "Implicit", "Reactive", "Passive"), ("Human", "Explicit", "Active", "Passive")]
    level = {f: "high" for f in FIELDS}
    schema = "run_key string, interaction_id string, turn_number int, seq int, " + ", ".join(f"{f} string" for f in FIELDS)
    other = spark.createDataFrame([("silver", "i", n, 0, *v) for n, v in enumerate(silver)], schema).withColumn(
        "confidence", F.struct(*[F.lit(v).alias(f) for f, v in level.items()])
    )
    mine = ruled.select(F.lit("rules").alias("run_key"), "interaction_id", "turn_number", F.lit(0).alias("seq"), *FIELDS, "confidence")
    return mine.unionByName(other)


def test_comparison(two_runs, rows):
    result = jobs.compare_runs(two_runs)
    assert rows(result.turns.select("turn_number", "disagreement_score", "ensemble_judgment_holder", "ensemble_delegation_awareness")) == [
        (0, 1.0, "Human", "Absent"), (1, 0.0, "Shared", "Explicit"), (2, 0.25, "AI", "Explicit"), (3, 0.25, "Human", "Explicit")]
    assert rows(result.turns.select("ensemble_confidence_judgment_holder").distinct()) == [("high",)]
    assert rows(result.turns.filter("turn_number = 3").select("ensemble_cognitive_engagement")) == [("Active",)]
    assert rows(result.summary.select("turns_compared", "rate", *[f"rate_{f}" for f in FIELDS])) == [
        (4, 0.375, 0.25, 0.5, 0.5, 0.25)]


def test_comparison_skips_single_turns(two_runs, rows):
    fewer = two_runs.filter((F.col("run_key") != "silver") | (F.col("turn_number") < 3))
    result = jobs.compare_runs(fewer)
    assert rows(result.summary.select("turns_compared", "turns_total", "turns_skipped", F.round("rate", 9))) == [
        (3, 4, 1, round(5 / 12, 9))]
    assert rows(result.skipped) == [("i", 3, ["silver"])]


def test_comparison_with_itself_is_zero(two_runs, rows):
    same = two_runs.filter("run_key = 'rules'")
    twice = same.unionByName(same.withColumn("run_key", F.lit("again")))
    assert rows(jobs.compare_runs(twice).summary.select("rate")) == [(0.0,)]


def test_missing_confidence_counts_as_medium(two_runs, rows):
    low = two_runs.withColumn("confidence", F.when(F.col("run_key") == "rules", F.col("confidence")))
    got = jobs.compare_runs(low).turns.select("ensemble_confidence_judgment_holder").distinct()
    assert rows(got) == [("low",)]


def test_last_row_of_a_turn_wins(two_runs, rows):
    again = two_runs.filter("run_key = 'rules'").withColumn("seq", F.lit(5)).withColumn("judgment_holder", F.lit("AI"))
    got = compare.last_per_turn(two_runs.unionByName(again)).filter("run_key = 'rules'").select("judgment_holder").distinct()
    assert rows(got) == [("AI",)]


def test_empty_benchmark_is_zero_and_passes(spark, rows):
    cols = "interaction_id string, rate double, example_count int, " + ", ".join(f"rate_{f} double" for f in FIELDS)
    summary = compare.benchmark_summary(spark.createDataFrame([], cols))
    assert rows(summary.select("item_count", "average_rate", "max_rate", "zero_disagreement_items")) == [(0, 0.0, 0.0, 0)]
    assert rows(compare.threshold_gate(summary, max_average=0.0).select("passed")) == [(True,)]


def _examples(spark, data, context="general"):
    return spark.createDataFrame(
        [(s, i, context, h) for s, i, h in data], "seq int, interaction_id string, context_module string, holder string"
    ).withColumn("hint", F.struct(F.col("holder").alias("judgment_holder"))).drop("holder")


def test_round_robin(spark, rows):
    ex = _examples(spark, [(1, "a", "Human"), (2, "b", "Human"), (3, "c", "AI"), (4, "d", "Shared"), (5, "e", "AI")])
    target = spark.createDataFrame([("t", "general"), ("u", "other")], "interaction_id string, context_module string")
    got = fewshot.select_examples(target, ex, max_examples=4)
    assert rows(got.select("interaction_id", F.transform("examples", lambda e: e["seq"]), "zero_shot_fallback")) == [
        ("t", [3, 1, 4, 5], False), ("u", [], True)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_round_robin_against_brute_force(spark, n):
    data = [(s, f"i{(s * s) % 11 if s % 3 else 0}", ["AI", "Human", "Shared", None][(s * 7) % 4]) for s in range(60)]
    ids = sorted({i for _, i, _ in data}) + ["none"]
    target = spark.createDataFrame([(i, "general") for i in ids], "interaction_id string, context_module string")
    got = {
        r[0]: r[1]
        for r in fewshot.select_examples(target, _examples(spark, data), max_examples=n)
        .select("interaction_id", F.transform("examples", lambda e: e["seq"])).collect()
    }
    for who in ids:
        buckets = {}
        for s, i, h in data:
            if i != who:
                buckets.setdefault(h or "Unknown", []).append(s)
        want = sorted((r, b, s) for b, found in buckets.items() for r, s in enumerate(found))
        assert got[who] == [s for _, _, s in want[:n]]


def test_only_own_examples_means_zero_shot(spark, rows):
    ex = _examples(spark, [(1, "a", "Human"), (2, "a", "AI")])
    target = spark.createDataFrame([("a", "general")], "interaction_id string, context_module string")
    assert rows(fewshot.select_examples(target, ex, max_examples=3).select("example_count", "zero_shot_fallback")) == [(0, True)]


def test_naive_bayes(spark, rows):
    train = spark.createDataFrame([(0, "a b", "X"), (1, "a", "X"), (2, "c", "Y")], "seq int, text string, f string")
    model = bayes.train(train, ["f"])
    texts = spark.createDataFrame([(1, "a"), (2, "")], "id int, text string")
    got = bayes.score(texts, model, key=["id"], classes={"f": ["X", "Y"]})
    assert rows(got.select("id", "token_count", "label", "margin", "level")) == [
        (1, 1, "X", round(math.log(2 / 3 * 3 / 6) - math.log(1 / 3 / 4), 9), "medium"),
        (2, 0, "X", round(math.log(2), 9), "low")]
    single = bayes.train(train.filter("f = 'X'"), ["f"])
    assert rows(bayes.score(texts.limit(1), single, key=["id"], classes={"f": ["X", "Y"]}).select("margin", "level")) == [(1.0, "medium")]


def test_naive_bayes_repeats_travel_as_counts(spark, rows):
    texts = spark.createDataFrame([(1, "b a b A c b"), (2, ""), (3, None)], "id int, text string")
    words = texts.select("id", F.array_sort(tokens(F.col("text"))).alias("_words"))
    found = bayes.token_runs(words, ["id"]).select("id", F.explode_outer("_runs").alias("r")).select("id", "r.*")
    assert sorted(rows(found), key=repr) == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (2, None, None), (3, None, None)]
    train = spark.createDataFrame([(0, "a b", "X"), (1, "a", "X"), (2, "c", "Y")], "seq int, text string, f string")
    got = bayes.score(texts, bayes.train(train, ["f"]), key=["id"], classes={"f": ["X", "Y"]}).filter("id = 1")
    x = math.log(2 / 3) + 2 * math.log(3) + 3 * math.log(2) - 6 * math.log(3 + 3)
    y = math.log(1 / 3) + math.log(2) - 6 * math.log(1 + 3)
    assert rows(got.select("token_count", "label", "margin")) == [(6, "X" if x > y else "Y", round(abs(round(x, 9) - round(y, 9)), 9))]


def test_naive_bayes_tie_goes_to_first_seen(spark, rows):
    train = spark.createDataFrame([(0, "a", "Y"), (1, "a", "X")], "seq int, text string, f string")
    texts = spark.createDataFrame([(1, "a z")], "id int, text string")
    got = bayes.score(texts, bayes.train(train, ["f"]), key=["id"], classes={"f": ["X", "Y"]})
    assert rows(got.select("label", "margin")) == [("Y", 0.0)]


def test_naive_bayes_reports_gaps(spark, rows):
    empty = spark.createDataFrame([], "seq int, text string, f string")
    assert rows(bayes.missing_fields(bayes.train(empty, ["f"]), ["f"])) == [(["f"], True)]


@pytest.mark.parametrize("n,want", [(6, [3, 1, 2]), (7, [4, 1, 2]), (1, [0, 0, 1]), (0, [0, 0, 0])])
def test_split_sizes(spark, n, want):
    items = spark.range(n).select(F.col("id").cast("string").alias("interaction_id"))
    assigned = splits.assign_splits(items, seed=3)
    counts = dict((r[0], r[1]) for r in splits.split_counts(assigned).collect())
    assert [counts.get(s, 0) for s in ("train", "validation", "test")] == want
    again = splits.assign_splits(items.repartition(7), seed=3)
    assert sorted(assigned.collect()) == sorted(again.collect())


def test_split_ratios_are_checked(spark):
    with pytest.raises(ValueError):
        splits.assign_splits(spark.range(1).select(F.lit("a").alias("interaction_id")), seed=1, train=0.9, validation=0.2)


def test_quality_gate(spark, rows):
    t = spark.createDataFrame(
        [("i", "Just decide", "As an AI I cannot", "Human")] * 2, "interaction_id string, human_input string, ai_response string, holder string"
    )
    ids = spark.createDataFrame([("i",), ("none",)], "interaction_id string")
    assert rows(quality_gate(t, ids)) == [
        ("i", 14, 7, ["duplicate_turn_pair", "human_turn_overdelegates", "meta_ai_phrase", "too_short_tokens"]),
        ("none", 0, 0, ["missing_turns"])]


def test_run_status(spark, rows):
    df = spark.createDataFrame([(0, 0, 0), (3, 3, 0), (3, 0, 3), (3, 2, 1)], "i int, c int, f int")
    got = df.select(identity.run_status(F.col("i"), F.col("c"), F.col("f")))
    assert [r[0] for r in got.collect()] == ["no_items_matched", "completed", "failed", "partial"]


def test_run_join_semantics(spark, rows):
    runs = spark.createDataFrame(
        [("r0", "x", None, "failed"), ("r1", "x", "d1", "failed"), ("r2", "y", "d1", "completed")],
        "run_id string, interaction_id string, dataset_id string, status string")
    items = spark.createDataFrame(
        [("d1", "x", "s1", None), ("d2", "x", "s2", None)], "dataset_id string, interaction_id string, scenario_id string, blueprint_id string")
    assert rows(catalog.runs_with_items(runs, items).select("run_id", "catalog_scenario_id")) == [
        ("r0", "s1"), ("r0", "s2"), ("r1", "s1"), ("r2", None)]
    assert rows(catalog.runs_by_scenario(runs, items)) == [("s1", "failed", 2), ("s2", "failed", 1), ("unknown", "completed", 1)]


def _retry(spark, failed, existing):
    p = spark.createDataFrame([(r, i, f"/o/{r}") for r, i in failed], "run_id string, position int, run_dir string")
    e = spark.createDataFrame([(r, f"/o/{r}") for r in existing], "run_id string, run_dir string")
    return {r["position"]: r["retry_run_id"] for r in catalog.retry_ids(p, e).collect()}


def test_retry_ids(spark):
    assert _retry(spark, [("r-1-retry-01", 1)], ["r-1-retry-01", "r-1"]) == {1: "r-1-retry-02"}


def test_retry_ids_against_sequential_search(spark):
    failed = [(f"b{(i * i) % 3}" + (f"-retry-{i:02d}" if i % 4 else ""), i) for i in range(1, 40)]
    existing = [r for r, _ in failed] + [f"b1-retry-{i:02d}" for i in range(5, 30, 2)] + ["b2-retry-100"]
    used, want = set(existing), {}
    for run, position in failed:
        base = run
        while len(base) > 9 and base[-9:-2] == "-retry-" and base[-2:].isdigit():
            base = base[:-9]
        i = position
        while f"{base}-retry-{i:02d}" in used:
            i += 1
        want[position] = f"{base}-retry-{i:02d}"
        used.add(want[position])
    assert _retry(spark, failed, existing) == want


def test_continuity(spark, rows):
    v = spark.createDataFrame(
        [("ok", 1, 0, 1), ("ok", 2, 1, 2), ("gap", 1, 0, 1), ("gap", 2, 2, 3), ("flat", 1, 2, 2)],
        "interaction_id string, pos int, from_turn int, to_turn int")
    ids = spark.createDataFrame([("ok",), ("gap",), ("flat",), ("none",)], "interaction_id string")
    assert rows(states.interaction_continuity(ids, v)) == [
        ("flat", 1, "non_increasing"), ("gap", 2, "broken"), ("none", 0, "empty"), ("ok", 2, None)]


def test_trajectory_parts_are_whole(ruled, rows):
    v = states.deltas(states.states(ruled, run_clock=CLOCK))
    parts = states.trajectories(v, part_vectors=2)
    assert rows(parts.select("part", F.transform("vectors", lambda x: x["to_turn"]))) == [(0, [1, 2]), (1, [3])]


def test_resume(spark, rows):
    cols = "interaction_id string, turn_number int, human_input string, ai_response string"
    t = spark.createDataFrame([("i", 0, "a", "b"), ("i", 1, "a", "c"), ("i", 2, None, "d"), ("i", 3, "n", "m")], cols)
    stored = spark.createDataFrame([("i", 0, "a", "b", 0), ("i", 1, "a", "old", 0), ("i", 2, "", "d", 0)], cols + ", seq int")
    assert rows(resume.reused_turns(t, stored).select("turn_number")) == [(0,), (2,)]
    assert rows(resume.turns_to_process(t, stored).select("turn_number")) == [(1,), (3,)]


def _answer(**change):
    body = {
        "judgment_holder": "Human", "delegation_awareness": "Explicit", "cognitive_engagement": "Active",
        "information_seeking": "None", "confidence": {f: "high" for f in FIELDS},
        "evidence_spans": [{"text": "q {x}", "category": "k"}], "observer_notes": "n", "observer_confidence": 0.5,
    }
    body.update(change)
    return json.dumps({k: v for k, v in body.items() if v != "drop"})


ANSWERS = [
    (_answer(), None), (f"```json\n{_answer()}\n```", None), (f"Well: {_answer()} then {{y}}", None),
    (_answer().replace('"', "“"), None), (_answer(judgment_holder="Robot"), "invalid_judgment_holder"),
    (_answer(judgment_holder=3), "invalid_judgment_holder"), (_answer(evidence_spans=[]), "no_evidence"),
    (_answer(evidence_spans="drop"), "no_evidence"), (_answer(evidence_spans={}), "evidence_not_array"),
    (_answer(evidence_spans=[{"text": "", "category": "k"}]), "span_invalid"),
    (_answer(evidence_spans=["x"]), "span_invalid"), (_answer(confidence="high"), "confidence_not_object"),
    (_answer(confidence={FIELDS[0]: "high"}), f"invalid_confidence_{FIELDS[1]}"),
    (_answer(observer_confidence=1.2), "observer_confidence_invalid"), (_answer(observer_confidence="0.4"), "observer_confidence_invalid"),
    (_answer(observer_confidence=None), None), (_answer(observer_confidence=True), None),
    (_answer(observer_notes=0), None), (_answer(observer_notes=[1]), "observer_notes_invalid"),
    (_answer()[: _answer().index('"evidence_spans"') + 30], None), (_answer()[: _answer().index('"confidence"') + 30], "invalid_json"),
    ("[1, 2]", "not_an_object"), ("no", "invalid_json"), ("", "invalid_json"), (None, "invalid_json"),
    (_answer().replace('{"judgment_holder"', '{"judgment_holder": "AI", "judgment_holder"', 1), None),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, response_text string")
    got = {r["i"]: r["parsed"] for r in responses.normalise(df).collect()}
    assert {i: got[i]["reason"] for i in got} == {i: why for i, (_, why) in enumerate(ANSWERS)}
    cut = got[19]
    assert cut["salvaged"] and cut["evidence_spans"][0]["category"] == "salvaged_evidence"
    assert got[16]["observer_confidence"] == 1.0 and got[0]["evidence_spans"][0]["text"] == "q {x}"


def test_text_after_a_closed_broken_object_is_ignored(spark):
    broken = _answer().replace(', "observer_notes"', ' "observer_notes"') + ' "judgment_holder": "AI"'
    df = spark.createDataFrame([(broken,)], "response_text string")
    parsed = responses.normalise(df).first()["parsed"]
    assert parsed["reason"] is None and parsed["salvaged"] and parsed["judgment_holder"] == "Human"


def test_json_search(spark, rows):
    data = ['x {"a":1} y', '}{ {"a":{"b":2}} tail', "{bad} {\"ok\":[1]}", '{"a":"}"} {"z":1}', '[{"q":1}]', "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    got = df.select("i", responses.first_object(F.col("t")).cast("string"), responses.first_json_object(F.col("t")))
    assert rows(got) == [
        (0, '{"a":1}', '{"a":1}'), (1, None, None), (2, '{"ok":[1]}', "{bad}"), (3, '{"a":"}"}', '{"a":"}"}'),
        (4, '{"q":1}', '{"q":1}'), (5, None, None)]


def test_salvage_of_one_member(spark, rows):
    df = spark.createDataFrame([('z {"h": "a \\"b\\"\\n c", tail',), ('{"h": "open',), ('{"h": 4}',)], "t string")
    assert [r[0] for r in df.select(responses.salvage_member(F.col("t"), "h")).collect()] == ['a "b"\n c', None, None]


def test_strip_cuts_every_white_space(spark):
    assert spark.createDataFrame([("   \tx y\n ",)], "t string").select(strip(F.col("t"))).first()[0] == "x y"


def test_attempts(spark, rows):
    bad = "no"
    data = [("m", "i", 0, a, t) for a, t in enumerate([bad, _answer(), _answer(judgment_holder="AI")])]
    data += [("m", "i", 1, a, bad) for a in range(2)] + [("m", "i", 2, a, bad) for a in range(4)]
    data += [("m", "i", 2, 4, _answer())]
    r = spark.createDataFrame(data, "model_id string, interaction_id string, turn_number int, attempt int, response_text string")
    got = prompts.first_valid_attempt(r)
    assert rows(got.select("turn_number", "attempt", "parsed.judgment_holder", F.size("tried"), "error")) == [
        (0, 1, "Human", 3, None), (1, None, None, 2, "invalid_json"), (2, None, None, 4, "invalid_json")]
    p = spark.createDataFrame([("i", n, "P") for n in range(3)], "interaction_id string, turn_number int, prompt string")
    work = prompts.repair_worklist(p, got).collect()
    assert [(w["turn_number"], w["next_attempt"]) for w in work] == [(1, 2)]
    assert work[0]["prompt"].startswith("P\nprevious_response_was_invalid_json") and work[0]["prompt"].endswith("previous_response:\nno\n")


def test_prompt_text(turns):
    rows = prompts.with_history(turns, chunk_rows=6).select("pos", prompts.observer_prompt().alias("p")).orderBy("pos").collect()
    assert rows[0]["p"] == (
        "interaction_id: i\ncontext_module: general\nturn_number: 0\n\n"
        f"current_turn_human: {G1[0]}\ncurrent_turn_ai: ok\n")
    assert f"conversation_history:\n[turn 0] Human: {G1[0]}\n[turn 0] AI: ok\n\ncurrent" in rows[1]["p"]


def test_rendered_example_is_json(spark):
    row = spark.sql(
        "select named_struct('interaction_id','a','turn_number',1,'context_module','general','human_input','say \"x\"\\n','ai_response','é',"
        "'hint',named_struct('judgment_holder','AI','delegation_awareness','Absent','cognitive_engagement','Active','information_seeking','None',"
        "'confidence',named_struct('judgment_holder','high','delegation_awareness','low','cognitive_engagement','low','information_seeking','low')),"
        "'evidence_spans',array(named_struct('text','t','category','c','note',cast(null as string))),'observer_notes','') as e")
    line = row.select(fewshot.rendered_example(F.col("e"))).first()[0]
    assert line == json.dumps(json.loads(line), ensure_ascii=False)
    assert json.loads(line)["input"]["human_input"] == 'say "x"\n'


DOC = {
    "interaction_id": "x", "context_module": "general", "participants": {"human_id": "h", "ai_id": "a"},
    "turns": [{"turn_number": n, "human_input": "q", "ai_response": "r", "timestamp": "yesterday"} for n in (0, 1)],
}


def test_document_contract(spark, tmp_path):
    def change(**kw):
        return {**json.loads(json.dumps(DOC)), **kw}

    docs = {
        "ok": DOC, "one": change(turns=DOC["turns"][:1]), "context": change(context_module="travel"),
        "key": change(extra=1), "turnkey": change(turns=[{**DOC["turns"][0], "x": 1}, DOC["turns"][1]]),
        "negative": change(turns=[{**DOC["turns"][0], "turn_number": -1}, DOC["turns"][1]]),
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    read = read_interactions(spark, str(tmp_path))
    got = {
        r["source_path"].rsplit("/", 1)[1][:-5]: r["violations"]
        for r in contracts.document_violations(read).select("source_path", "violations").collect()
    }
    assert got == {
        "ok": [], "one": ["too_few_turns"], "context": ["context_module_unknown"], "key": ["unknown_key"],
        "turnkey": ["unknown_key"], "negative": ["turn_number_negative"]}
    t = flatten_turns(read.filter(F.col("source_path").endswith("ok.json")))
    assert [(r["pos"], r["turn_time"]) for r in t.orderBy("pos").collect()] == [(0, "yesterday"), (1, "yesterday")]
    hinted = labels.hint_labels(t)
    assert [r["error"] for r in hinted.collect()] == ["missing_hint"] * 2
    bad_time = states.states(labels.rule_labels(t, keep=["turn_time"]), run_clock=CLOCK, turn_time=F.col("turn_time"))
    assert contracts.state_violations(bad_time).first()["violations"] == ["timestamp_invalid"]


def test_template_filling(spark):
    slots = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("B"))
    texts = ["x {a} {b}", "{{a}} {b}", "{c}", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(generate.fill_template(F.col("t"), slots), generate.has_unknown_slot(F.col("t"), slots)).collect()
    assert [tuple(r) for r in got] == [("x {b} B", False), ("{a} B", False), ("{c}", True), ("plain", False), (None, False)]
