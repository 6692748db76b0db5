"""The given tables read as the inputs of this package.

Text of the tables is invented prose, so the rule track gets phrases that occur in it, and
labels and recorded responses are derived from a digest of each turn's key.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstate.functions.text import digit, excerpt, one_of
from turnstate.operators import labels as L
from turnstate.operators import prompts as P
from turnstate.schemas import CONTEXTS, FIELDS, HINT, LEVELS, allowed_values
from turnstate.sources.chat import turns_from_chat

RUN_CLOCK = "2026-01-01T00:00:00Z"
RULE_PHRASES = {
    "human_led": [" with ", " der "],
    "exploration": [" for "],
    "delegation": [" by "],
    "retention": [" que "],
    "hedging": [" this ", " from "],
}
MODELS = ["model-a", "model-b"]
ATTEMPTS = 3
RUNS = ["hints", "model-a", "rules"]


# Plans are kept so that queries over the same table share its scan and exchanges.
@lru_cache(maxsize=64)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _digest(prefix: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts]).cast("binary"))


def context_of(number: Column) -> Column:
    return one_of(CONTEXTS, number % len(CONTEXTS))


@lru_cache(maxsize=16)
def turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns_from_chat(table(spark, sf, "conversations"))
    return rows.select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string")).alias("interaction_id"),
        context_of(F.col("conv_id")).alias("context_module"),
        "pos", "turn_number", "human_input", "ai_response",
    )


@lru_cache(maxsize=16)
def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation with its participants; some contexts and names are bad."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    d = _digest("doc", F.col("conv_id"))
    return ids.select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string")).alias("interaction_id"),
        F.when(digit(d, 0, 16) == 0, "travel").otherwise(context_of(F.col("conv_id"))).alias("context_module"),
        F.when(digit(d, 1, 16) == 0, "").otherwise("human-1").alias("human_id"),
        F.lit("ai-1").alias("ai_id"),
    )


def labels_from(digest: Column) -> list[Column]:
    return [
        one_of(allowed_values(f), digit(digest, i, len(allowed_values(f)))).alias(f)
        for i, f in enumerate(FIELDS)
    ]


def levels_from(digest: Column) -> list[Column]:
    return [one_of(LEVELS, digit(digest, 4 + i, 3)).alias(f) for i, f in enumerate(FIELDS)]


@lru_cache(maxsize=16)
def hinted_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with an embedded label; about one in eight has none."""
    rows = turns(spark, sf).withColumn("_d", _digest("hint", F.col("interaction_id"), F.col("turn_number")))
    d = F.col("_d")
    hint = F.struct(
        *labels_from(d),
        F.struct(*levels_from(d)).alias("confidence"),
        F.lit(None).cast("map<string,string>").alias("extensions"),
    ).cast(HINT)
    return rows.withColumn("hint", F.when(digit(d, 8, 8) != 0, hint)).drop("_d")


@lru_cache(maxsize=16)
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.rule_labels(turns(spark, sf), RULE_PHRASES)


@lru_cache(maxsize=16)
def hint_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.hint_labels(hinted_turns(spark, sf))


def _json(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


@lru_cache(maxsize=16)
def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded responses of two models, three attempts a turn, many broken in known ways."""
    rows = turns(spark, sf).select(
        "interaction_id", "turn_number", "human_input",
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model_id"),
    ).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))))
    rows = rows.withColumn(
        "_d", _digest("resp", F.col("model_id"), F.col("interaction_id"), F.col("turn_number"), F.col("attempt"))
    )
    d, case = F.col("_d"), digit(F.col("_d"), 8, 16)
    names, levels = labels_from(d), levels_from(d)
    holder = F.when(case == 2, "Robot").otherwise(names[0])
    values = [holder, *names[1:]]
    head = F.concat(
        F.lit("{"),
        *[F.concat(F.lit(f'"{f}": "'), v, F.lit('", ')) for f, v in zip(FIELDS, values)],
    )
    level_parts = [
        F.when((case == 4) & F.lit(i == 1), F.lit(None)).otherwise(F.concat(F.lit(f'"{f}": "'), v, F.lit('"')))
        for i, (f, v) in enumerate(zip(FIELDS, levels))
    ]
    confidence = F.concat(F.lit('"confidence": {'), F.concat_ws(", ", *level_parts), F.lit("}"))
    span = F.concat(F.lit('{"text": '), _json(excerpt(F.col("human_input"), 40)), F.lit(', "category": "quoted"}'))
    spans = F.concat(F.lit('"evidence_spans": ['), F.when(case == 3, "").otherwise(span), F.lit("]"))
    certainty = F.when(case == 5, "1.2").when(case == 12, "true").otherwise("0.5")
    glue = F.when(case == 11, " ").otherwise(", ")
    whole = F.concat(
        head, confidence, F.lit(", "), spans, glue,
        F.lit('"observer_notes": "noted", "observer_confidence": '), certainty, F.lit("}"),
    )
    text = (
        F.when(case == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(case == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" Anything {else}?")))
        .when(case == 6, F.concat(head, confidence, F.lit(', "evidence_spans": [{"text": "cut')))
        .when(case == 7, F.concat(head, F.lit('"confidence": {"judgment_holder": "hi')))
        .when(case == 8, F.replace(whole, F.lit('"'), F.lit("“")))
        .when(case == 9, "I would rather not answer.")
        .when(case == 10, "[1, 2, 3]")
        .otherwise(whole)
    )
    return rows.select("model_id", "interaction_id", "turn_number", "attempt", text.alias("response_text"))


@lru_cache(maxsize=16)
def observer_labels(spark: SparkSession, sf: str, model: str) -> DataFrame:
    return P.observer_labels(turns(spark, sf), responses(spark, sf), model_id=model)


@lru_cache(maxsize=16)
def compared_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of three runs in comparison layout; turns in error are absent.

    About one in five hint rows is stored twice, the second time as an AI label.
    """
    layout = lambda df, run, seq: df.filter(F.col("error").isNull()).select(
        F.lit(run).alias("run_key"), "interaction_id", "turn_number", F.lit(seq).alias("seq"),
        *FIELDS, "confidence",
    )
    hints = hint_labels(spark, sf)
    d = _digest("again", F.col("interaction_id"), F.col("turn_number"))
    again = hints.filter(digit(d, 0, 5) == 0).withColumn("judgment_holder", F.lit("AI"))
    return (
        layout(rule_labels(spark, sf), "rules", 0)
        .unionByName(layout(hints, "hints", 0))
        .unionByName(layout(again, "hints", 1))
        .unionByName(layout(observer_labels(spark, sf, "model-a"), "model-a", 0))
    )


@lru_cache(maxsize=16)
def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """One scenario per part: slots from its columns, two blueprints for every third size."""
    part = table(spark, sf, "part")
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    meta = F.lit(None).cast("struct<timestamp:string,jsv_hint:%s>" % HINT.simpleString())

    def template(number, human, reply):
        options = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else none
        single = lambda v: text if isinstance(v, list) else F.lit(v)
        return F.struct(
            F.lit(number).alias("turn_number"),
            single(human).alias("human_input"), options(human).alias("human_input_options"),
            single(reply).alias("ai_response"), options(reply).alias("ai_response_options"),
            meta.alias("meta"),
        )

    plain = F.array(*[template(n, h, r) for n, h, r in PLAIN_TEMPLATES])
    blueprints = F.array(
        *[
            F.struct(
                F.lit(b).alias("blueprint_id"),
                F.array(*[template(n, h, r) for n, h, r in ts]).alias("turn_templates"),
            )
            for b, ts in BLUEPRINTS
        ]
    )
    return part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("scenario_id"),
        F.col("p_name").alias("title"),
        context_of(F.col("p_size")).alias("context_module"),
        F.lit(None).cast("struct<human_id:string,ai_id:string>").alias("participants"),
        F.create_map(
            F.lit("item"), F.array("p_name", "p_brand"),
            F.lit("kind"), F.array(F.col("p_type"), F.lower("p_type"), F.lit("plain")),
        ).alias("slot_options"),
        F.when(F.col("p_size") % 3 != 0, plain).alias("turn_templates"),
        F.when(F.col("p_size") % 3 == 0, blueprints).alias("blueprints"),
    )


PLAIN_TEMPLATES = [
    (0, ["I look at {item} and hesitate.", "Is {item} worth it?", "Tell me about {item}."],
     "It is a {kind} article."),
    (1, "Set {{limits}} for {item} please.", ["Keep it {kind}.", "Ask for {kind} only."]),
]
BLUEPRINTS = [
    ("short", [(0, "Weigh {item} for me.", "Here are points on {kind}."), (1, "Fine, I choose.", "Good.")]),
    ("long", [(0, "Start with {item}.", ["First {kind}.", "Then {kind}."]), (1, "And next?", "Compare {item}."),
              (2, "Done with {colour}.", "Agreed.")]),
]


@lru_cache(maxsize=16)
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert log of runs from orders: twenty base ids, each with numbered retries."""
    o = table(spark, sf, "orders")
    base = F.concat(F.lit("r-"), (F.col("o_custkey") % 20).cast("string"))
    suffix = F.col("o_orderkey") % 100
    run_id = F.when(suffix < 3, base).otherwise(
        F.concat(base, F.lit("-retry-"), F.lpad(suffix.cast("string"), 2, "0"))
    )
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        run_id.alias("run_id"),
        F.concat(F.lit("i-"), (F.col("o_orderkey") % 300).cast("string")).alias("interaction_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("d-"), (F.col("o_custkey") % 3).cast("string"))).alias("dataset_id"),
        F.concat(F.lit("dr-"), (F.col("o_custkey") % 50).cast("string")).alias("dataset_run_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "heuristic_baseline").otherwise("fixture_hint").alias("track_name"),
        F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string")).alias("input_path"),
        F.concat(F.lit("/runs/"), run_id).alias("run_dir"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
    )


@lru_cache(maxsize=16)
def crowded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run per order: a third of them retries of one run, the others of a run per customer.

    Failed runs carry their number as a chain of two-digit retries, the others as one index.
    """
    o = table(spark, sf, "orders")
    base = F.when(F.col("o_orderkey") % 3 == 0, "r-hot").otherwise(F.concat(F.lit("r-"), F.col("o_custkey").cast("string")))
    number = F.col("o_orderkey").cast("string")
    chain = F.regexp_replace(F.lpad(number, 12, "0"), "(..)", "-retry-$1")
    single = F.concat(F.lit("-retry-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        F.concat(base, F.when(failed, chain).otherwise(single)).alias("run_id"),
        F.lit("/runs/all").alias("run_dir"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )


@lru_cache(maxsize=16)
def dataset_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of four datasets from customers, one per dataset and interaction."""
    c = table(spark, sf, "customer")
    return c.groupBy(
        F.concat(F.lit("d-"), (F.col("c_custkey") % 4).cast("string")).alias("dataset_id"),
        F.concat(F.lit("i-"), (F.col("c_custkey") % 350).cast("string")).alias("interaction_id"),
    ).agg(
        F.min("c_mktsegment").alias("scenario_id"),
        F.min("c_name").alias("blueprint_id"),
        F.min("c_custkey").alias("seq"),
    )
