"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight per feature for all thresholds, which
are kept in order. Features are the presence of words, word beginnings and word endings. The
expected severity of a text is the sum over k of P(grade > k).

The model is fitted on a bounded sample of labelled rows (SAMPLE, the rows of the smallest
hashes). Spark counts every feature of the sample per class and keeps those that lean to one
side; only the kept features of the sample rows reach the driver, where the weights are
fitted. Every text is then scored whole, in tasks that hold the model alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

SAMPLE = 12_000  # labelled rows that the model is fitted on
FEATURES = 20_000  # features of the model, the most telling first
SEEN, LEAN = 4, 5.0  # rows a feature must be in, and standard errors from the mean share
TELLING = 0.5  # share of toxic rows from which a feature marks a word as toxic
STEPS = (3, 6)  # different toxic words from which a toxic text is of grade 2, 3
AFFIXES = (3, 4, 5, 6)
CACHED = 400_000  # words that a worker remembers
STRENGTH, ROUNDS, RATE = 1e-4, 400, 0.1  # ridge, gradient steps and their size

WORD = re.compile(r"[^\W\d_]+")
SCORE = "severity double, grade int, p_toxic double"


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def features_of(word: str) -> list[str]:
    heads = [word[:k] + "*" for k in AFFIXES if len(word) > k]
    tails = ["*" + word[-k:] for k in AFFIXES[1:] if len(word) > k]
    return [word, *heads, *tails]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows and toxic rows per feature; the totals under an empty feature."""
    for batch in batches:
        rows, toxic = Counter(), Counter()
        for text, bad in zip(batch["text"], batch["toxic"]):
            found = {f for word in words_of(text) for f in features_of(word)} | {""}
            rows.update(found)
            if bad:
                toxic.update(found)
        yield pd.DataFrame({"feature": list(rows), "n": list(rows.values()), "bad": [toxic[f] for f in rows]})


def screened(sample: DataFrame) -> tuple[dict[str, int], set[str]]:
    """Kept features with their numbers, and those that mark toxic words."""
    counts = sample.select("text", "toxic").mapInPandas(count_features, "feature string, n long, bad long")
    counts = stored(counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "features")
    total = counts.filter("feature = ''").first()
    if total is None or not 0 < total["bad"] < total["n"]:
        return {}, set()
    share = total["bad"] / total["n"]
    lean = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    kept = counts.filter((F.col("feature") != "") & (F.col("n") >= SEEN) & (F.abs(lean) >= LEAN))
    kept = kept.select("feature", (F.col("bad") >= TELLING * F.col("n")).alias("telling"), F.abs(lean).alias("lean"))
    rows = kept.orderBy(F.desc("lean"), "feature").limit(FEATURES).collect()
    return {r["feature"]: k for k, r in enumerate(rows)}, {r["feature"] for r in rows if r["telling"]}


def sample_rows(index: dict[str, int], telling: set[str]):
    """Feature numbers per row, and how many different words have a telling feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, hits = [], []
            for text in batch["text"]:
                own = [(word, features_of(word)) for word in words_of(text)]
                numbers.append(sorted({index[f] for _, fs in own for f in fs if f in index}))
                hits.append(sum(any(f in telling for f in fs) for _, fs in own))
            yield batch[["toxic", "grade"]].assign(numbers=numbers, hits=hits)

    return run


def fitted(rows: list[np.ndarray], grades: np.ndarray, features: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the most likely ordinal model, by Adam on the whole sample."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.concatenate([*rows, np.empty(0)]).astype(np.int64)
    # Thresholds: the first one and the logarithms of the gaps, so they stay in order.
    at_most = np.array([(np.sum(grades <= k) + 1) / (len(grades) + 2) for k in range(levels - 1)])
    cuts = np.log(at_most / (1 - at_most))
    free = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))]
    value = np.r_[np.zeros(features), free]
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, ROUNDS + 1):
        weights, gaps = value[:features], np.exp(value[features + 1 :])
        cuts = value[features] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(row, weights[column], minlength=len(rows))
        bounds = np.r_[-np.inf, cuts, np.inf]
        upper, lower = (1 / (1 + np.exp(np.clip(score - bounds[grades + k], -500, 500))) for k in (1, 0))
        chance = np.maximum(upper - lower, 1e-12)
        high, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_score = (high - low) / len(rows)
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, grades + 1, -high / len(rows))
        np.add.at(by_cut, grades, low / len(rows))
        by_cut = by_cut[1:levels]
        after = np.cumsum(by_cut[::-1])[::-1]
        slope = np.r_[np.bincount(column, by_score[row], minlength=features) + STRENGTH * weights, after[0], after[1:] * gaps]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        value = value - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return value[:features], value[features] + np.r_[0, np.cumsum(np.exp(value[features + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model for labels (key, toxic) with an optional ordinal `grade` (0: none, then 1, 2 ...).

    Without grades, a toxic row is graded by how many of its different words carry a feature
    that marks toxic rows: 1, or 2 and 3 from STEPS on. Rows with a null key or null label are
    not used; a key with several labels takes the highest. Without both kinds of rows the
    model has no features and calls nothing toxic.
    """
    grade = F.col("grade") if "grade" in labels.columns else F.lit(None).cast("int")
    own = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"), grade.cast("int").alias("grade"))
    own = own.groupBy("key").agg(F.max("toxic").alias("toxic"), F.max("grade").alias("grade"))
    # At most SAMPLE short rows: a bounded broadcast.
    chosen = F.broadcast(own.orderBy(F.xxhash64("key"), "key").limit(SAMPLE))
    sample = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("text", "toxic", "grade"), "labelled")
    index, telling = screened(sample)
    if not index:
        return Model({}, np.zeros(0), np.array([np.inf]))
    rows = sample.mapInPandas(sample_rows(index, telling), "toxic int, grade int, numbers array<int>, hits int").toPandas()
    grades = np.where(rows["toxic"] > 0, 1 + np.searchsorted(STEPS, rows["hits"], side="right"), 0)
    if rows["grade"].notna().any():
        grades = rows["grade"].fillna(0).to_numpy()
    grades = np.unique(grades.astype(np.int64), return_inverse=True)[1]
    if grades.max() == 0:
        return Model({}, np.zeros(0), np.array([np.inf]))
    return Model(index, *fitted([np.asarray(n) for n in rows["numbers"]], grades, len(index), int(grades.max()) + 1))


def scorer(model: Model):
    """A Pandas function: texts to (severity, grade, p_toxic)."""
    known: dict[str, tuple[int, ...]] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        scores = np.zeros(len(texts))
        for k, text in enumerate(texts):
            found: set[int] = set()
            for word in words_of(text):
                numbers = known.get(word)
                if numbers is None:
                    if len(known) >= CACHED:
                        known.clear()
                    numbers = known[word] = tuple(model.index[f] for f in features_of(word) if f in model.index)
                found.update(numbers)
            scores[k] = model.weights[list(found)].sum() if found else 0.0
        above = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - scores[:, None], -500, 500)))
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype("int32"), "p_toxic": above[:, 0]})

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """The rows of `docs` with struct column `toxicity`: (severity, grade, p_toxic).

    `grade` is the number of thresholds that are more likely passed than not; from grade 1 on a
    text is toxic. A null text counts as empty, and an empty one has the severity of a text
    without features. Repeated rows are scored alike. A column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, object] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        if "run" not in state:
            state["run"] = scorer(held.value)
        return state["run"](texts)

    return docs.withColumn(name, F.pandas_udf(run, SCORE)(F.col(text)))


def reject_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` below grade 1, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return score(rows, model).filter("toxicity.grade < 1").select("row.*")
