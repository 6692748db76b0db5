"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from turnstate.llm import byte_bpe, decontaminate, language_crf, secrets, sharding, simhash, templates, topk, toxicity, url_templates

import public_tokenizers

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, `row` string, `a.b` int"
LONG = " ".join(f"word{k % 97}" for k in range(30_000))
ROWS = [
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "s", 0, "x", "y", 1),
    (None, "some text without an id\nand a second line", "en", "s", 5, "x", "y", 1),
    (None, None, None, None, None, None, None, None),
    (3, "same line here\nother words in this one", "en", "s", 5, "x", "y", 1),
    (3, "same line here\nother words in this one", "en", "s", 5, "x", "y", 1),
    (4, "same line here\nother words in this one", "en", "s", 5, "x", "y", 1),
    (5, LONG, "en", "s", 5, "x", "y", 1),
    (6, "x" * 50_000, "en", "s", 5, "x", "y", 1),
    (7, " \n\t\n ", "de", "s", 5, "x", "y", 1),
    (8, "0123456789 !!! 🙂", "de", "s", 5, "x", "y", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "...")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0), (2, 1), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")


def every(docs, benchmark, labels):
    model = toxicity.fit(docs, labels)
    crf = language_crf.fit(docs)
    return {
        "shards": sharding.assign(docs, 1000),
        "secrets": secrets.scan(docs),
        "groups": simhash.groups(docs),
        "one": simhash.keep_one(docs),
        "lines": templates.drop_recurring_lines(docs),
        "toxic": toxicity.score(docs, model),
        "clean": toxicity.reject_toxic(docs, model),
        "lang": language_crf.predict(docs, crf),
        "tokens": byte_bpe.encode_checked(docs, PATH, public_tokenizers.PATTERN),
        "leaks": decontaminate.leaks(docs, benchmark),
        "unleaked": decontaminate.remove_leaks(docs, benchmark),
    }


def test_odd_rows(docs, benchmark, labels):
    found = {name: df.collect() for name, df in every(docs, benchmark, labels).items()}
    for name in ("shards", "secrets", "groups", "lines", "toxic", "lang", "tokens", "unleaked"):
        assert len(found[name]) == len(ROWS), name
    assert found["leaks"] == []
    for name in ("one", "clean", "lines", "unleaked"):
        assert all(set(r.asDict()) == set(docs.columns) for r in found[name]), name
    # Texts without words are one group, and so are the equal texts; the smallest key stays.
    assert sorted((r["doc_id"] for r in found["one"]), key=lambda x: (x is None, x)) == [1, 3, 5, 6, 8, None]
    groups = [(r["doc_id"], r["component_id"]) for r in found["groups"]]
    assert groups.count((3, 3)) == 2 and (4, 3) in groups and (1, 1) in groups and (2, 1) in groups and (7, 1) in groups
    assert [r["fingerprint"] for r in found["groups"] if r["doc_id"] == 1] == ["0" * 16]
    lines = {r["doc_id"]: r["text"] for r in found["lines"]}
    assert lines[3] == ROWS[4][1] and lines[4] == "" and lines[1] is None and lines[7] == ROWS[9][1]
    assert {r["doc_id"]: r["language"]["label"] for r in found["lang"]}[8] == "und"
    assert {r["language"]["label"] for r in found["lang"] if r["text"] is None} == {"und"}
    assert all(r["tokens"]["restored"] for r in found["tokens"])
    assert {r["tokens"]["n_tokens"] for r in found["tokens"] if not r["text"]} == {0}
    assert all(r["a.b"] == 1 for r in found["shards"] if r["text"] is not None)


def test_empty_tables(nothing, benchmark, labels):
    for name, df in every(nothing, benchmark, labels).items():
        assert df.count() == 0, name


def test_shards_fit_their_limit(docs):
    sizes = {}
    for r in sharding.assign(docs, 1000).collect():
        sizes.setdefault(r["shard"]["name"], []).append(r["shard"]["bytes"])
    assert all(sum(own) <= 1000 or len([b for b in own if b]) == 1 for own in sizes.values())


def test_equal_rows_over_the_limit_are_dealt_into_parts(spark):
    rows = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    sizes = {}
    for r in sharding.assign(rows, 1000).collect():
        sizes[r["shard"]["name"]] = sizes.get(r["shard"]["name"], 0) + r["shard"]["bytes"]
    assert sum(sizes.values()) == 5000 and len(sizes) > 3 and all("#" in name for name in sizes)


def test_write_shards_makes_a_folder_each(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as doc_id", "repeat('ab', 50) as text")
    sharding.write_shards(rows, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200
    assert max(r["n"] for r in back.groupBy("shard_name").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()) <= 40


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, id int, vector string"
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.0], 1, "a"), (3, None, 1, "a"), (4, [None, 1.0], 1, "a"),
        (5, [nan, 1.0], 1, "a"), (6, [inf, 1.0], 1, "a"), (7, [], 1, "a"), (8, [1.0, 2.0, 3.0], 1, "a"), (None, [9.0, 9.0], 1, "a"),
        (20, [1.0, 0.0], 1, "a"), (20, [1.0, 0.0], 1, "a"), (9, [3e38, -3e38], 1, "a"), (40, [-1.0, 2.0, 0.5], 1, "a"),
    ]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, schema)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=3).collect()}
    assert got[0, 1][0] == 9 and got[0, 2] == (1, 4096) and got[0, 3] == (2, 4096)
    assert got[20, 2] == (0, 4096) and got[20, 3] == (1, 4096) and (20, 4) not in got
    assert got[40, 1][0] == 8 and (40, 2) not in got
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_urls(spark):
    schema = "page_id long, url string, bad int, host string, path string"
    rows = [
        (1, None, None, "h", "p"), (2, "no scheme", None, "h", "p"), (3, "HTTP://WWW.Example.ORG", None, "h", "p"), (4, "x://a.org/es/1?q", 1, "h", "p"),
        (5, "x://example.org/es/1?q", 0, "h", "p"), (6, "x://sub.example.org/en/12#f", 0, "h", "p"), (7, "x://site.com/fr/" + "/".join("abcdefghijkl"), None, "h", "p"),
        (8, "x://notexample.org/es/1", None, "h", "p"), (8, "x://notexample.org/es/1", None, "h", "p"), (9, "x:///only/path", None, "h", "p"), (10, "x://É.com/de/", None, "h", "p"),
    ]
    rules = [url_templates.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]
    frame = spark.createDataFrame(rows, schema)
    found = url_templates.judge(frame, rules).collect()
    assert len(found) == len(rows) and all(r["host"] == "h" and r["path"] == "p" for r in found)
    got = {r["page_id"]: (r["judged"]["host"], r["judged"]["path"], r["judged"]["rule"], r["judged"]["verdict"]) for r in found}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.org", "", None, "allow")
    assert got[4][2:] == ("org/", "allow") and got[5][2:] == ("example.org/es/", "block") and got[6] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("org/", "allow") and got[9][:2] == ("", "/only/path") and got[10][0] == "É.com" and got[10][2:] == ("com/de/", "block")
    assert url_templates.judge(frame.limit(0), rules).count() == 0
