"""Language ID by a linear-chain conditional random field over the words of a text.

A word's features are its character n-grams with marks at both ends, so that beginnings and
endings are features of their own, the word itself, and the lexicons it is in. Transitions
between the languages of neighbouring words are learned with them. Forward-backward gives
every word's probabilities, also where a text changes language; a text's language is the one
with the largest sum over its words.

Fitted on a bounded sample of labelled texts (DOCS per language, SEQUENCES runs of WINDOW
words); runs are cut from lines of different texts put end to end, so the sample holds changes
of language. Whole texts are then labelled, each line being a chain, in tasks that hold the
model alone. Chains of a batch go through the recursions together, longest first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
DOCS, LINES, WINDOW = 300, 3_000, 64  # sample: texts and lines per language, words of a run
LINE_WORDS = 400  # a longer line of the sample counts as several
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
LEXICON = 200  # most frequent words of a language in the sample
STRENGTH, ROUNDS, RATE = 1e-4, 60, 0.1
BATCH_CHARS, CACHED = 2_000_000, 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)

WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    labels: list[str]
    lexicon: dict[str, list[int]]  # word to the numbers of the languages that list it
    weights: np.ndarray  # (buckets + languages, languages): n-grams and words, then lexicons
    transitions: np.ndarray
    start: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def lines_of(text: str) -> list[list[str]]:
    """Lower-case words of each line that has any."""
    return [words for line in text.lower().split("\n") if (words := WORD.findall(line))]


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of every feature of the words, by owner."""
    codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(codes))  # characters to the end of the word, itself included
    owners, found = [], []
    rolling = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * MIX + codes[n - 1 :] if n <= len(codes) else rolling[:0]
        if n in GRAMS:
            held = left[: len(rolling)] >= n
            owners.append(owner[: len(rolling)][held])
            found.append(rolling[held] * MIX + np.uint64(n))
    # The word as a whole: the sum of its characters, each mixed with its place.
    place = sizes[owner] - left
    mixed = (codes + place.astype(np.uint64) * np.uint64(0x1F123BB5)) * MIX
    mixed ^= mixed >> np.uint64(29)
    owners.append(np.arange(len(words)))
    found.append(np.add.reduceat(mixed * MIX, ends - sizes) if len(words) else mixed)
    hashed = [((f * MIX) >> np.uint64(48)).astype(np.int64) for f in found]
    listed = [(k, BUCKETS + label) for k, word in enumerate(words) for label in lexicon.get(word, ())]
    listed = np.array(listed, dtype=np.int64).reshape(-1, 2)
    owner, feature = np.concatenate([*owners, listed[:, 0]]), np.concatenate([*hashed, listed[:, 1]])
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


def word_scores(owner: np.ndarray, feature: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the feature weights of each word; every word has features."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.add.reduceat(weights[feature], starts, axis=0)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of every word of chains laid end to end, and, if asked for, the summed
    marginals of neighbouring pairs and the log-likelihood's partition sums."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(transitions)
    ahead, scale = np.empty_like(emit), np.empty(len(emit))
    for t, n in enumerate(active):
        at = begin[:n] + t
        value = emit[at] * (np.exp(start) if t == 0 else ahead[at - 1] @ step)
        total = value.sum(axis=1)
        ahead[at], scale[at] = value / total[:, None], total
    behind = np.ones_like(emit)
    joint = np.zeros_like(step)
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        coming = emit[at] * behind[at] / scale[at][:, None]
        behind[at - 1] = coming @ step.T
        if pairs:
            joint += (ahead[at - 1].T @ coming) * step
    marginals = ahead * behind
    marginals /= marginals.sum(axis=1, keepdims=True)
    return (marginals, joint, np.log(scale) + top[:, 0]) if pairs else marginals


def fit_sequences(sequences: list[list[str]], tags: list[np.ndarray], labels: list[str]) -> Model:
    """The model of the most likely labels, by Adam over the whole sample."""
    counts = [Counter() for _ in labels]
    for words, own in zip(sequences, tags):
        for word, tag in zip(words, own):
            counts[tag][word] += 1
    lexicon: dict[str, list[int]] = {}
    for label, found in enumerate(counts):
        for word, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(label)
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for words in sequences for w in words])
    tag = np.concatenate(tags)
    owner, feature = features(list(known), lexicon)
    sizes = np.array([len(s) for s in sequences])
    first = np.cumsum(sizes) - sizes
    n = len(labels)
    inner = np.ones(len(tag), dtype=bool)
    inner[first] = False
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (tag[np.flatnonzero(inner) - 1], tag[inner]), 1)
    seen_start = np.bincount(tag[first], minlength=n).astype(float)
    value = [np.zeros((BUCKETS + n, n)), np.zeros((n, n)), np.zeros(n)]
    first_moment, second_moment = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
    for step in range(1, ROUNDS + 1):
        weights, transitions, start = value
        scores = word_scores(owner, feature, weights)[flat]
        marginals, joint, _ = forward_backward(scores, sizes, transitions, start, pairs=True)
        # Expected minus seen, brought from words in place to different words to features.
        gap = marginals.copy()
        gap[np.arange(len(tag)), tag] -= 1
        by_word = np.stack([np.bincount(flat, gap[:, k], minlength=len(known)) for k in range(n)], axis=1)
        by_feature = np.stack([np.bincount(feature, by_word[owner, k], minlength=BUCKETS + n) for k in range(n)], axis=1)
        slopes = [by_feature, joint - seen_pairs, marginals[first].sum(axis=0) - seen_start]
        for k, slope in enumerate(slopes):
            slope = slope / len(tag) + STRENGTH * value[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * slope
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * slope * slope
            value[k] = value[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return Model(labels, lexicon, value[0].astype(np.float32), value[1], value[2])


def sample_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (label, " ".join(words[k : k + LINE_WORDS]))
            for text, label in zip(batch["text"], batch["label"]) for words in lines_of(text) for k in range(0, len(words), LINE_WORDS)
        ]
        yield pd.DataFrame(rows, columns=["label", "words"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """The model for the labelled rows of `docs`, or None without any.

    Rows with a null text or label are not used. The sample is the DOCS rows of the smallest
    key hashes per language; only its lines, LINES per language, reach the driver. So a language
    is learned from its own rows, however many others there are and however long their texts.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    place = F.expr(f"row_number() over (partition by `{label}` order by xxhash64(`{key}`), `{key}`)")
    chosen = rows.select(F.col(key), F.col(label)).withColumn("place", place).filter(F.col("place") <= DOCS)
    chosen = F.broadcast(chosen.select(F.col(key).alias("key")).distinct())  # DOCS short rows per language
    texts = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).join(chosen, "key", "left_semi")
    lines = texts.mapInPandas(sample_lines, "label string, words string")
    by_label = Window.partitionBy("label").orderBy(F.xxhash64("words"), "words")
    lines = lines.withColumn("place", F.row_number().over(by_label)).filter(F.col("place") <= LINES)
    lines = lines.orderBy(F.xxhash64("words"), "words", "label").collect()
    labels = sorted({r["label"] for r in lines})
    if not labels:
        return None
    words = [w for r in lines for w in r["words"].split()]
    tags = np.array([labels.index(r["label"]) for r in lines for _ in r["words"].split()])
    cuts = range(0, len(words), WINDOW)
    return fit_sequences([words[c : c + WINDOW] for c in cuts], [tags[c : c + WINDOW] for c in cuts], labels)


class Labeller:
    """The model in a worker, with the scores of the words seen so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, len(model.labels)), dtype=np.float32)

    def word_marginals(self, chains: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known, self.scores = {}, self.scores[:0]
        fresh = list(set().union(*chains).difference(self.known))
        if fresh:
            new = word_scores(*features(fresh, self.model.lexicon), self.model.weights)
            self.known.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.scores = np.concatenate([self.scores, new])
        sizes = np.array([len(c) for c in chains], dtype=np.int64)
        flat = np.fromiter((self.known[w] for c in chains for w in c), dtype=np.int64, count=int(sizes.sum()))
        return forward_backward(self.scores[flat], sizes, self.model.transitions, self.model.start)

    def texts(self, texts: list[str]) -> list[tuple[str, float]]:
        chains, owner = [], []
        for k, text in enumerate(texts):
            own = lines_of(text) if has_letter(text) else []
            chains += own
            owner += [k] * sum(map(len, own))
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if chains:
            marginals = self.word_marginals(chains)
            totals = np.stack([np.bincount(owner, marginals[:, k], minlength=len(texts)) for k in range(marginals.shape[1])], axis=1)
            words = np.bincount(owner, minlength=len(texts))
            for k in np.flatnonzero(words):
                best = int(totals[k].argmax())
                found[k] = (self.model.labels[best], float(min(1.0, max(0.0, totals[k, best] / words[k]))))
        return found


def predict(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> DataFrame:
    """The rows of `docs` with struct column `language`: (label, score).

    `score` is the mean probability of the label over the words, 0 to 1. A text that is null,
    empty or without letters is `und` with score 0, and so is every text without a model. Equal
    sums take the label that sorts first. A column of that name is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("label"), F.lit(0.0).alias("score")))
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Labeller] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        if "own" not in state:
            state["own"] = Labeller(held.value)
        rows, waiting, size = [], [], 0
        for text in texts:
            waiting.append(text or "")
            size += len(waiting[-1])
            if size >= BATCH_CHARS:
                rows += state["own"].texts(waiting)
                waiting, size = [], 0
        rows += state["own"].texts(waiting)
        return pd.DataFrame(rows, columns=["label", "score"])

    return docs.withColumn(name, F.pandas_udf(run, "label string, score double")(F.col(text)))


def held_out(key: Column) -> Column:
    """Whether a row is kept out of the sample: CRC-32 of the key as text is 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
