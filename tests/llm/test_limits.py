"""Results that must not change with the size of other rows, and limits that must hold."""

import pytest
from pyspark.sql import functions as F

from turnstate.llm import language_crf, sharding, url_templates


@pytest.mark.parametrize("limit", [200, 1000])
def test_no_part_of_equal_rows_exceeds_the_limit(spark, limit):
    equal = spark.createDataFrame([(1, "x" * 150)] * 200, "doc_id long, text string").repartition(5)
    others = spark.range(2, 60).selectExpr("id as doc_id", "repeat('ab', 40) as text")
    rows = sharding.assign(equal.unionByName(others), limit).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]["name"]] = sizes.get(r["shard"]["name"], 0) + r["shard"]["bytes"]
    assert len(rows) == 258 and max(sizes.values()) <= limit


def test_sharding_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "own", "part", "e", "entry6", "bits", "bytes", "source", "row", "__cell"]
    rows = spark.createDataFrame([tuple(range(1, 12))] * 3, names).withColumn("text", F.lit("abc"))
    found = sharding.assign(rows, 1).collect()
    assert [r.asDict(recursive=True) | {"shard": None} for r in found] == [r.asDict() | {"shard": None} for r in rows.collect()]


def pages(spark, sections, bad, segment):
    """A host with so many sections of 60 pages; the pages of one are labelled bad."""
    name = lambda s: "section" + chr(97 + s // 26) + chr(97 + s % 26)
    rows = [(s * 60 + k, f"http://h.net/{segment or name(s) if s == bad else name(s)}/p{k}", int(s == bad)) for s in range(sections) for k in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, bad int")


@pytest.mark.parametrize("sections", [20, 150])
@pytest.mark.parametrize("segment", [None, "*"])
def test_a_section_is_judged_alike_on_small_and_large_hosts(spark, sections, segment):
    found = url_templates.judge(pages(spark, sections, 7, segment), []).select("bad", "judged.verdict").groupBy("bad", "verdict").count().collect()
    assert {(r["bad"], r["verdict"]): r["count"] for r in found} == {(1, "block"): 60, (0, "allow"): 60 * (sections - 1)}


def test_a_language_of_short_texts_is_learned_beside_long_ones(spark, monkeypatch):
    monkeypatch.setattr(language_crf, "LINES", 60)
    long = lambda lang, words: [(f"{lang}{k}", "\n".join(" ".join(words[(k + j + i) % len(words)] for i in range(8)) for j in range(80)), lang) for k in range(20)]
    rows = long("aa", ["ber", "dun", "kol", "wem", "zur"]) + long("bb", ["chi", "fou", "joie", "que", "tres"])
    rows += [(f"cc{k}", "pala mita soro", "cc") for k in range(3)]
    model = language_crf.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    texts = spark.createDataFrame([("x", "soro pala mita pala"), ("y", "kol wem ber dun")], "doc_id string, text string")
    assert {r["doc_id"]: r["language"]["label"] for r in language_crf.predict(texts, model).collect()} == {"x": "cc", "y": "aa"}
