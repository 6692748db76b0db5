"""Registered queries of this subpackage, one per operator, over whole tables.

Each takes the rows from its operator and keeps the columns that the query's contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstate.llm import alignment, byte_bpe, decontaminate, filter_audit, language_crf, packing, secrets, sharding, simhash, templates
from turnstate.llm import topk, toxicity, url_templates
from turnstate.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
SHARD_BYTES = 2 * 1024 * 1024
SEQUENCE_TOKENS = 2048
BYTE_LEVEL, SENTENCE_PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# The rules every page is judged by.
URL_RULES = [
    url_templates.Rule("allow", "org", "/"),
    url_templates.Rule("block", "example.org", "/es/"),
    url_templates.Rule("block", "example.org", "/en/1"),
    url_templates.Rule("allow", "com", "/fr/"),
    url_templates.Rule("block", "com", "/de/"),
]


def labelled_pages(spark, sf_dir):
    """(page_id, url, bad): a page shows the document whose number is in its path; bad means
    toxic or of low quality by that document's label, and null without one."""
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad")
    )
    path = url_templates.host_and_path(F.col("url"))[1]
    number = F.expr("try_cast(n as bigint)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(path, "/([0-9]+)", 1).alias("n"))
    pages = pages.select("page_id", "url", number.alias("doc_id"))
    return pages.join(labels, "doc_id", "left").select("page_id", "url", "bad")


@query
def op1_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    rows = url_templates.judge(labelled_pages(spark, sf_dir), URL_RULES)
    return rows.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.template")


@query
def op2_byte_level_bpe(spark, sf_dir):
    """Token count and digests of ids and decoded bytes of every document."""
    path = public_tokenizers.path(BPE_RANKS)
    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return rows.select("doc_id", "tokens.*")


@query
def op3_benchmark_decontamination(spark, sf_dir):
    """Benchmark items found in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


@query
def op4_top_k_search(spark, sf_dir):
    """The 20 best inner products of every query vector, over all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op5_sharding(spark, sf_dir):
    """The shard of every document: hash prefix, its length in bits and the text's bytes."""
    rows = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return rows.select("doc_id", F.col("shard.name").alias("shard"), F.col("shard.level").alias("level"), F.col("shard.bytes").alias("n_bytes"))


@query
def op6_toxicity(spark, sf_dir):
    """Expected severity, grade and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return rows.select("doc_id", "toxicity.severity", "toxicity.grade", (F.col("toxicity.grade") >= 1).alias("toxic"))


@query
def op7_language_id(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept_out = language_crf.held_out(F.col("doc_id"))
    model = language_crf.fit(docs.filter(~kept_out))
    rows = language_crf.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", kept_out.alias("held_out"), F.col("language.label").alias("lang_pred"), "language.score")


@query
def op8_secret_scans(spark, sf_dir):
    """Spans of secrets in every document."""
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "secrets.*")


@query
def op9_line_dedup(spark, sf_dir):
    """Every document without the lines whose template an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.drop_recurring_lines(docs)


@query
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document, three-word shingles, 3 bits."""
    return simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_best_fit_packing(spark, sf_dir):
    """The place of every piece of every document in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = packing.pieces(docs, public_tokenizers.path(BYTE_LEVEL), SEQUENCE_TOKENS)
    rows = rows.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return packing.pack(rows, SEQUENCE_TOKENS)


@query
def op12_cross_tokenizer_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers, in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = alignment.align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(SENTENCE_PIECES))
    return rows.select("doc_id", "alignment.*")


@query
def op13_filter_interaction_audit(spark, sf_dir):
    """What five filters keep, remove and lose in every order of theirs, per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))
