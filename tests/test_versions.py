"""Manifests written last, bucketed histories, repaired streams, retry ids in chunks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.operators import catalog, labels, states
from turnstate.plans import jobs
from turnstate.sinks import tables
from turnstate.sinks.versions import Versions, bucket_of, publish
from turnstate.streaming import repaired

ROWS = "k string, v int"


def test_readers_see_old_or_new_never_half(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "pub")
    table = lambda n: spark.createDataFrame([("a", n)], ROWS)
    store = Versions(spark, root)
    assert store.current().number == 0 and store.read("one", ROWS).count() == 0
    publish(spark, root, {"one": table(1), "two": table(1)}, run="r1")
    writes, add = [], Versions.add

    def dies_at_the_second(self, df, name, bucket=None):
        writes.append(name)
        if len(writes) == 2:
            raise RuntimeError("killed")
        return add(self, df, name, bucket)

    monkeypatch.setattr(Versions, "add", dies_at_the_second)
    with pytest.raises(RuntimeError, match="killed"):
        publish(spark, root, {"one": table(2), "two": table(2)}, run="r2")
    read = lambda: [rows(store.read(n, ROWS)) for n in ("one", "two")]
    assert read() == [[("a", 1)], [("a", 1)]] and store.current().notes["run"] == "r1"
    # A job that dies while its manifest is written leaves a folder without a manifest file.
    (tmp_path / "pub" / "versions" / "v000000000002" / "_temporary").mkdir(parents=True)
    assert store.current().number == 1
    monkeypatch.setattr(Versions, "add", add)
    publish(spark, root, {"two": table(3)}, run="r3")
    assert read() == [[("a", 1)], [("a", 3)]] and store.current().number == 2


def test_only_wanted_buckets_are_opened(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    df = spark.range(200).selectExpr("cast(id as string) as k", "cast(id as int) as v")
    bucket = bucket_of("k", buckets=8)
    done = store.commit(store.current(), store.add(df, "t", bucket))
    assert len(done.of("t")) == 8
    one = store.read("t", ROWS, buckets=[3])
    assert {f.split("/")[-2] for f in one.inputFiles()} == {"_bucket=3"}
    assert one.count() == df.filter(bucket == 3).count() and store.read("t", ROWS).count() == 200


SCHEMA = T.StructType().add("k", "string").add("at", "long").add("v", "string")
SCALE = ["lo", "mid", "hi"]


def arrive(spark, base, data, **options):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    repaired.repaired_steps(stream, f"{base}/out", f"{base}/check", key="k", order_by=["at"], value="v", ordered=SCALE, buckets=4, **options)
    return repaired.current_steps(spark, f"{base}/out", SCHEMA, "k", ["at"])


def test_late_rows_are_repaired(spark, rows, tmp_path, segments=2):
    batches = [
        [("a", 2, "hi"), ("a", 9, "lo"), ("b", 1, "odd"), (None, 5, "lo")],
        [("a", 5, "mid"), ("b", 3, "hi"), ("a", 9, "lo"), (None, 4, "hi")],  # one row again
        [("a", 1, "lo"), ("a", 7, "hi"), ("a", 6, "lo"), ("c", 1, "lo")],
        [("b", 2, "mid"), ("a", 12, None), ("c", 0, "hi")],
    ]
    seen = set()
    for batch in batches:
        seen |= set(batch)
        got = arrive(spark, str(tmp_path), batch, segments=segments)
        want = states.ordinal_steps(spark.createDataFrame(sorted(seen, key=str), SCHEMA), "k", ["at"], "v", SCALE)
        assert rows(got.select(*want.columns)) == rows(want)
    store = Versions(spark, str(tmp_path / "out"))
    per_bucket = [p.bucket for p in store.current().of("rows")]
    assert max(per_bucket.count(b) for b in per_bucket) <= segments


def test_rows_behind_the_horizon_are_set_aside(spark, rows, tmp_path):
    base = str(tmp_path)
    schema = T.StructType().add("k", "string").add("at", "timestamp").add("v", "string")

    def run(data):
        spark.createDataFrame(data, "k string, at string, v string").select("k", F.col("at").cast("timestamp").alias("at"), "v").coalesce(1).write.mode(
            "append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        repaired.repaired_steps(stream, f"{base}/out", f"{base}/check", key="k", order_by=["at"], value="v", ordered=SCALE, lateness="1 hour", buckets=2, segments=2)
        return rows(repaired.current_steps(spark, f"{base}/out", schema, "k", ["at"]).select(F.hour("from_at"), F.hour("to_at"), "delta"))

    day = "2026-01-01 0"
    assert run([("a", f"{day}1:00:00", "lo"), ("a", f"{day}5:00:00", "hi")]) == [(1, 5, 1.0)]
    # Before 04:00 is final; 04:30 is not.
    assert run([("a", f"{day}2:00:00", "mid"), ("a", f"{day}4:30:00", "mid")]) == [(1, 4, 0.5), (4, 5, 0.5)]
    assert run([("a", f"{day}8:00:00", "lo")]) == [(1, 4, 0.5), (4, 5, 0.5), (5, 8, -1.0)]
    store = Versions(spark, f"{base}/out")
    assert store.read("late", "k string, at timestamp, v string, seq bigint").count() == 1
    # What is kept of the history: the last final row and those after the horizon.
    assert run([("a", f"{day}8:30:00", "hi")])[-1] == (8, 8, 1.0)
    assert run([("a", f"{day}9:00:00", "mid")])[-1] == (8, 9, -0.5)
    assert sorted(r["at"].hour for r in store.read("rows", schema).collect()) == [5, 8, 8, 9]


def test_a_committed_batch_is_not_done_twice(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, base, [("a", 1, "lo"), ("a", 2, "hi")])
    number = Versions(spark, f"{base}/out").current().number
    # The stream's own log is lost after the commit: the batch runs again under the same number.
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    repaired.repaired_steps(stream, f"{base}/out", f"{base}/other", key="k", order_by=["at"], value="v", ordered=SCALE, buckets=4)
    assert Versions(spark, f"{base}/out").current().number == number


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    base, opened, read = str(tmp_path), [], Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, name, schema, **o: opened.append((name, o.get("buckets"))) or read(self, name, schema, **o))
    key = "interaction_id string, turn_number int, human_input string, ai_response string"
    labels = T.StructType(T._parse_datatype_string(key).fields).add("label", "string")
    track = lambda turns: turns.withColumn("label", F.upper("human_input"))

    def run(data):
        spark.createDataFrame(data, key).coalesce(1).write.mode("append").parquet(f"{base}/in")
        repaired.resume_labels(spark.readStream.schema(key).parquet(f"{base}/in"), f"{base}/out", track, labels, f"{base}/check", buckets=16, segments=2)
        return {(r["interaction_id"], r["turn_number"]): (r["label"], r["seq"]) for r in repaired.stored_labels(spark, f"{base}/out", labels).collect()}

    first = [(f"i{k}", n, f"h{k}", "a") for k in range(20) for n in range(2)]
    assert set(run(first).values()) == {(f"H{k}", 0) for k in range(20)}
    opened.clear()
    done = run([("i3", 0, "h3", "a"), ("i3", 1, "changed", "a"), ("i3", 2, "new", None)])
    assert done["i3", 0] == ("H3", 0) and done["i3", 1] == ("CHANGED", 1) and done["i3", 2] == ("NEW", 1) and len(done) == 41
    assert [len(b) for name, b in opened if b is not None] == [1]
    for batch in (2, 3):
        assert run([("i3", 2, f"new {batch}", "")])["i3", 2] == (f"NEW {batch}", batch)


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_retry_ids_of_a_hot_base_in_chunks(spark, max_rows):
    failed = [("hot" + "".join(f"-retry-{d:02d}" for d in divmod(k, 90)), k) for k in range(1, 200, 2)] + [("cold", 4), ("cold-retry-09", 6)]
    used = [f"hot-retry-{k:02d}" for k in range(3, 400, 3)] + ["cold-retry-04", "cold-retry-05", "hot", "hot-retry-06"]
    p = spark.createDataFrame([(r, "/runs/" + r, k) for r, k in failed], "run_id string, run_dir string, position int")
    e = spark.createDataFrame([(r, "/runs/" + r) for r in used], "run_id string, run_dir string")
    got = {r["run_id"]: r["retry_run_id"] for r in catalog.retry_ids(p, e, max_rows=max_rows).collect()}
    taken, want = set(used), {}
    for run_id, at in sorted(failed, key=lambda x: x[1]):
        base = run_id.split("-retry-")[0]
        while f"{base}-retry-{at:02d}" in taken:
            at += 1
        want[run_id] = f"{base}-retry-{at:02d}"
        taken.add(want[run_id])
    assert got == want


# --- whole runs, publications and the run catalog

CLOCK = "2026-01-01T00:00:00Z"
TURN = "interaction_id string, context_module string, pos int, turn_number int, human_input string, ai_response string"


@pytest.fixture(scope="module")
def talks(spark):
    turns = spark.createDataFrame([(i, "general", n, n, t, "ok") for i in ("a", "b") for n, t in enumerate(["compare x and y", "you decide"])]
                                  + [("short", "general", 0, 0, "hello", "ok")], TURN)
    people = turns.select("interaction_id", "context_module", F.lit("h").alias("human_id"), F.lit("m").alias("ai_id")).distinct()
    return people, turns


def test_a_run_is_read_whole_or_not_at_all(spark, talks, tmp_path, monkeypatch):
    out, write = str(tmp_path / "run"), tables.write_table
    job = lambda: jobs.run_extraction(*talks, labels.rule_labels, out=out, run_id="r", run_clock=CLOCK)
    read = lambda name="states": tables.committed_run(spark, out, "r", name)

    def dies_at(name):
        def run(df, path, **options):
            if path.endswith(name):
                raise RuntimeError("killed")
            return write(df, path, **options)
        return run

    for name in ("/extracts", "/run_manifests"):
        monkeypatch.setattr(tables, "write_table", dies_at(name))
        with pytest.raises(RuntimeError, match="killed"):
            job()
        assert spark.read.parquet(f"{out}/states").count() == 4
        with pytest.raises(LookupError):
            read()
    monkeypatch.setattr(tables, "write_table", write)
    job()
    assert read().count() == 4 and read("run_errors").count() == 1 and read("run_manifests").count() == 3
    monkeypatch.setattr(tables, "write_table", dies_at("/deltas"))
    with pytest.raises(RuntimeError, match="killed"):
        job()
    with pytest.raises(LookupError):  # its states are new and its deltas old
        read()


def test_a_publication_that_dies_is_not_read(spark, rows, tmp_path, monkeypatch):
    target = str(tmp_path / "pub")
    items = lambda v: spark.createDataFrame([("i", v), ("j", v)], "item_id string, v int")
    give = lambda v: tables.publish_if_complete(spark, items(v), staging=str(tmp_path / "staging"), target_path=target, target_count=2)
    with pytest.raises(LookupError):
        tables.published(spark, target)
    give(1)
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        give(2)
    # Part of a version, as an interrupted job commit leaves it.
    items(9).limit(1).withColumn("version", F.lit(3)).write.mode("append").partitionBy("version").parquet(target)
    assert rows(tables.published(spark, target)) == [("i", 1), ("j", 1)]
    monkeypatch.setattr(Versions, "commit", commit)
    give(4)
    assert rows(tables.published(spark, target)) == [("i", 4), ("j", 4)]


def test_a_dataset_run_fills_the_catalog_that_retries_start_from(spark, talks, rows, tmp_path):
    items = spark.createDataFrame([("d", k, i, "s", "train", f"in/{i}.json") for k, i in enumerate(["a", "short", "gone"])],
                                  "dataset_id string, seq int, interaction_id string, scenario_id string, split string, relative_path string")
    out = str(tmp_path / "ds")
    jobs.run_dataset(items, *talks, labels.rule_labels, track_name="t", out=out, run_clock=CLOCK)
    log = spark.read.parquet(f"{out}/runs")
    assert rows(log.groupBy("status").count()) == [("completed", 1), ("failed", 2), ("running", 3)]
    runs = catalog.latest(log, ["run_id"])
    assert rows(runs.select("run_id", "status", "error_message", "input_path")) == [
        ("t-a", "completed", None, "in/a.json"), ("t-gone", "failed", "not_extracted", "in/gone.json"),
        ("t-short", "failed", "contract:too_few_turns", "in/short.json")]
    work = catalog.retry_worklist(runs, items.select("dataset_id", "interaction_id", "scenario_id", F.lit(None).cast("string").alias("blueprint_id"), "seq"))
    assert rows(work.select("original_run_id", "retry_run_id", "input_path")) == [
        ("t-gone", "t-gone-retry-01", "in/gone.json"), ("t-short", "t-short-retry-02", "in/short.json")]


def test_tracks_run_together_equal_those_run_alone(spark, talks, rows, tmp_path):
    people, turns = talks
    hint = F.when(F.col("pos") == 0, F.struct(F.lit("AI").alias("judgment_holder"), F.lit("Explicit").alias("delegation_awareness"),
                  F.lit("Active").alias("cognitive_engagement"), F.lit("None").alias("information_seeking"),
                  F.lit(None).cast("struct<judgment_holder:string,delegation_awareness:string,cognitive_engagement:string,information_seeking:string>").alias("confidence"),
                  F.lit(None).cast("map<string,string>").alias("extensions")))
    turns = turns.withColumn("hint", hint)
    tracks = {"rules": labels.rule_labels, "hints": labels.hint_labels, "again": labels.rule_labels}
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    path = str(tmp_path / "turns")
    turns.write.parquet(path)
    assert scans(labels.together(spark.read.parquet(path), tracks)) == 1
    run = jobs.extract_together(people, turns, tracks, run_clock=CLOCK)
    for label, track in tracks.items():
        alone = jobs.extract(people, turns, track, run_clock=CLOCK)
        for name in ("states", "deltas", "errors", "manifest"):
            one = getattr(alone, name)
            assert rows(getattr(run, name).filter(F.col("label") == label).select(*one.columns)) == rows(one), (label, name)
    items = people.select("interaction_id", F.lit("train").alias("split"))
    done = jobs.run_matrix_together(tracks, items, people, turns, out=str(tmp_path / "m"), run_id="r", run_clock=CLOCK, split="train")
    assert rows(done.groupBy("label", "status").count()) == [
        ("again", "completed", 2), ("again", "failed", 1), ("hints", "failed", 3), ("rules", "completed", 2), ("rules", "failed", 1)]
    assert tables.committed_run(spark, str(tmp_path / "m"), "r", "states").count() == 8
