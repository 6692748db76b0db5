"""Naive Bayes labels: counts trained and scored as joins and aggregations.

A model is three tables: `classes(field, label, doc_count, total_tokens, first_seq)`,
`tokens(field, label, token, cnt)` and `vocabulary(field, size)`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.functions.identity import margin_level
from turnstate.functions.text import excerpt, tokens
from turnstate.operators.labels import _finish
from turnstate.schemas import FIELDS, allowed_values

LABEL_CLASSES = {f: allowed_values(f) for f in FIELDS}
# Scores are compared after rounding so that the order of additions cannot break a tie.
DIGITS = 9
# Tokens with at least 1/FREQUENT of all training tokens are joined through SALTS keys.
FREQUENT = 200
# Span categories, certainty, note and names of the label track.
SPAN_CATEGORIES = ("cheap_ml_tokens", "cheap_ml_excerpt")
TRACK_FACTS = (0.55, "Naive Bayes prediction from few-shot pack", "cheap_ml_baseline", "cheap-ml-v1")
SALTS = 32


@dataclass(frozen=True)
class Model:
    classes: DataFrame
    tokens: DataFrame
    vocabulary: DataFrame


def train(
    examples: DataFrame, fields: Sequence[str] = FIELDS, *,
    saved: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Model:
    """Count from examples with `seq`, `text` and one label column per field.

    Counting first by all labels together keeps the exploded tokens single; the copies per
    field are made from the counts. `saved` may write the counts and hand them back.
    """
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])
    ).alias("_f")
    counted = (
        examples.select(*fields, F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("token", *fields)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("token", per_field, "_n")
        .groupBy("_f.field", "_f.label", "token")
        .agg(F.sum("_n").alias("cnt"))
    )
    counted = saved(counted)
    # Texts are cut into tokens once; totals and vocabulary come from the counts.
    docs = (
        examples.groupBy(*fields)
        .agg(F.count(F.lit(1)).alias("_docs"), F.min("seq").alias("_first"))
        .select(per_field, "_docs", "_first")
        .groupBy("_f.field", "_f.label")
        .agg(F.sum("_docs").alias("doc_count"), F.min("_first").alias("first_seq"))
    )
    totals = counted.groupBy("field", "label").agg(F.sum("cnt").alias("_total"))
    classes = docs.join(totals, ["field", "label"], "left").select(
        "field", "label", "doc_count", F.coalesce("_total", F.lit(0)).alias("total_tokens"), "first_seq"
    )
    sizes = counted.groupBy("field", "token").agg(F.lit(1).alias("_one")).groupBy("field").agg(
        F.count("_one").alias("size")
    )
    return Model(classes, counted, sizes)


def missing_fields(model: Model, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Fields a model does not cover; one row, empty when complete."""
    present = F.collect_set("field")
    return model.classes.agg(
        F.array_sort(F.array_except(F.array(*[F.lit(f) for f in fields]), present)).alias(
            "missing"
        ),
        (F.count(F.lit(1)) == 0).alias("untrained"),
    )


@dataclass(frozen=True)
class Scoring:
    """A model laid out for scoring: `weights(token, _salts, _salt, _w0, _w1 ...)` with one weight
    per class, `frequent(token, _salts)`, and `constants(field, label, ...)`, one row per class."""

    weights: DataFrame
    frequent: DataFrame
    constants: DataFrame
    classes: tuple[tuple[str, str], ...]


def prepare(model: Model, classes: Mapping[str, Sequence[str]] = LABEL_CLASSES) -> Scoring:
    """Lay a model out for scoring. `classes` gives the order; trained labels it does not list
    are scored like any other, so the class list comes from the model's few class rows.

    A frequent token is a hot join key. Its texts spread over SALTS keys and its one model
    row is repeated for each; no more than FREQUENT tokens can reach the share.
    """
    listed = [(f, l) for f, labels in classes.items() for l in labels]
    seen = {(r["field"], r["label"]) for r in model.classes.select("field", "label").distinct().collect()}
    names = (*listed, *sorted(c for c in seen if None not in c and c not in listed))
    wide = model.tokens.groupBy("token").agg(
        F.sum("cnt").alias("_seen"),
        *[
            F.max(F.when((F.col("field") == f) & (F.col("label") == l), F.log(F.col("cnt") + 1.0))).alias(f"_w{i}")
            for i, (f, l) in enumerate(names)
        ],
    )
    everything = model.tokens.agg(F.sum("cnt").alias("_all")).withColumn("_one", F.lit(1))
    marked = wide.withColumn("_one", F.lit(1)).join(F.broadcast(everything), "_one").withColumn(
        "_salts", F.when(F.col("_seen") * FREQUENT >= F.col("_all"), SALTS).otherwise(1)
    )
    weights = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    totals = model.classes.groupBy("field").agg(F.sum("doc_count").alias("_docs"))
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(1))
    constants = (
        model.classes.join(totals, "field")
        .join(model.vocabulary, "field", "left")
        .select(
            "field", "label", "first_seq",
            F.log(F.col("doc_count") / F.col("_docs")).alias("prior"),
            F.log((F.col("total_tokens") + size).cast("double")).alias("per_token"),
        )
    )
    return Scoring(
        weights.drop("_seen", "_one", "_all"),
        frequent(weights),
        constants,
        names,
    )


def frequent(weights: DataFrame) -> DataFrame:
    """The salted tokens, at most FREQUENT."""
    return weights.filter((F.col("_salts") > 1) & (F.col("_salt") == 0)).select("token", "_salts")


def token_runs(words: DataFrame, kept: Sequence[str]) -> DataFrame:
    """`_runs` (token, times) of the sorted `_words` of each row, counted inside the row."""
    placed = F.transform("_words", lambda w, i: F.struct(w.alias("token"), i.alias("at")))
    new = lambda w: (w["at"] == 0) | (w["token"] != F.get("_words", w["at"] - 1))
    firsts = words.select(*kept, F.size("_words").alias("_size"), F.filter(placed, new).alias("_firsts"))
    end = lambda k: F.coalesce(F.get("_firsts", k + 1)["at"], F.col("_size"))
    runs = F.transform("_firsts", lambda w, k: F.struct(w["token"].alias("token"), (end(k) - w["at"]).alias("times")))
    return firsts.select(*kept, runs.alias("_runs"))


def score(
    texts: DataFrame, model: Model | Scoring, *, key: Sequence[str],
    classes: Mapping[str, Sequence[str]] = LABEL_CLASSES,
) -> DataFrame:
    """Best label and margin per text and field.

    Each different token of a text is joined once, whatever the number of classes. A stored `Scoring`
    has a known size, so Spark broadcasts it when it fits and shuffles by (token, salt)
    when it does not.
    """
    ready = model if isinstance(model, Scoring) else prepare(model, classes)
    names = ready.classes
    # The size is taken below the explode; above it, it would be computed once per token.
    words = texts.select(*key, tokens(F.col("text")).alias("_words")).withColumn("_n", F.size("_words"))
    words = words.select(*key, "_n", F.array_sort("_words").alias("_words"))
    runs = token_runs(words, [*key, "_n"])
    rows = (
        runs.select(*key, "_n", F.explode_outer("_runs").alias("_run"))
        .select(*key, "_n", "_run.token", "_run.times")
        .join(F.broadcast(ready.frequent), "token", "left")
        .withColumn("_salt", F.pmod(F.hash(*key), F.coalesce("_salts", F.lit(1))))
    )
    sums = rows.join(ready.weights.drop("_salts"), ["token", "_salt"], "left").groupBy(*key).agg(
        F.max("_n").alias("token_count"),
        *[F.coalesce(F.sum(F.col("times") * F.col(f"_w{i}")), F.lit(0.0)).alias(f"_s{i}") for i in range(len(names))],
    )
    by_class = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.lit(l).alias("label"), F.col(f"_s{i}").alias("weight"))
                for i, (f, l) in enumerate(names)
            ]
        )
    ).alias("c")
    # One row per class, and the classes are the ones listed: a fixed bound.
    scored = (
        sums.select(*key, "token_count", by_class)
        .select(*key, "token_count", "c.*")
        .join(F.broadcast(ready.constants), ["field", "label"])
        .withColumn(
            "_score",
            F.round(F.col("prior") + F.col("weight") - F.col("token_count") * F.col("per_token"), DIGITS),
        )
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("s"), "first_seq", "label")))
    best = scored.groupBy(*key, "field", "token_count").agg(ranked.alias("r"))
    second = F.get("r", F.lit(1))
    return best.select(
        *key, "token_count", "field",
        F.get("r", F.lit(0))["label"].alias("label"),
        F.round(
            F.when(F.size("r") < 2, 1.0).otherwise(second["s"] - F.get("r", F.lit(0))["s"]), DIGITS
        ).alias("margin"),
    ).withColumn("level", margin_level(F.col("margin")))


def bayes_labels(turns: DataFrame, model: Model | Scoring, *, model_id: str = "naive-bayes-v1") -> DataFrame:
    """Label track: both texts of a turn scored against a trained model."""
    key = ["interaction_id", "turn_number"]
    text = F.concat_ws(" ", "human_input", "ai_response")
    found = score(turns.select(*key, text.alias("text")), model, key=key)
    wide = found.groupBy(*key).agg(
        *[F.max(F.when(F.col("field") == f, F.col("label"))).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col("field") == f, F.col("level"))).alias(f"_level_{f}") for f in FIELDS],
    )
    words = F.slice(tokens(text), 1, 4)
    none = F.lit(None).cast("string").alias("note")
    evidence = F.when(
        F.size(words) > 0,
        F.struct(F.array_join(words, " ").alias("text"), F.lit(SPAN_CATEGORIES[0]).alias("category"), none),
    ).otherwise(
        F.struct(
            excerpt(F.col("human_input"), 160).alias("text"), F.lit(SPAN_CATEGORIES[1]).alias("category"), none
        )
    )
    df = turns.join(wide, key).select(
        *turns.columns,
        *FIELDS,
        F.struct(*[F.col(f"_level_{f}").alias(f) for f in FIELDS]).alias("confidence"),
        F.array(evidence).alias("evidence_spans"),
        F.lit(TRACK_FACTS[0]).alias("observer_confidence"),
        F.lit(TRACK_FACTS[1]).alias("observer_notes"),
        F.lit(None).cast(T.StringType()).alias("error"),
    )
    return _finish(df, TRACK_FACTS[2], model_id, TRACK_FACTS[3])
