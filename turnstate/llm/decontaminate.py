"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages, weighted by TF-IDF over the words of the benchmark
(other words cannot bring a passage nearer to an item). A randomised SVD of all passages gives
a latent space: every partition multiplies its passages into a sketch, the sketches are summed
by term, and the factors come from the sum. Benchmark items are rows of the same matrix,
weighted to the mass of the corpus, so their directions are in the space. Passages whose
cosine to an item is high are candidates; a candidate is a leak if the longest common
subsequence of the words around it covers the item, or covers less and holds its answer.

The vocabulary, the sketch and the factors are bounded by a block of ITEMS benchmark items; a
larger benchmark is searched block by block. Document counts of terms, the sketch and the
search cover every passage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

WIDTH, STRIDE = 64, 48  # words of a passage, and from one to the next
ITEMS = 512  # benchmark items of a block
EXTRA = 32  # dimensions beyond the items
COSINE = 0.42
COMMON, LEAST = 0.1, 0.5  # terms in more of the passages weigh nothing, if their items keep this share of theirs
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.6
SHORT = 8  # an item with fewer words must be there word for word
BATCH_WORDS = 300_000  # words of documents cut into passages at once
CHUNK = 64  # passages multiplied at once
TERM_ROWS, SALTS = 64, 16  # rows of a piece of the sketch, and first-level sums of each piece

LEAK = "key string, item_id long, covered double, answered double, cosine double"

WORD = re.compile(r"[^\W_]+")
# Where every character that is not ASCII is a letter or digit below U+0250, splitting bytes
# gives the same words in less than half the time.
ODD = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x250) if not WORD.match(chr(c))) + "\u0250-\U0010ffff]")
SEPARATED = bytes(b if b >= 0x80 or WORD.match(chr(b)) else 0x20 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts(batch: pd.DataFrame) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, word ids of documents) for runs of rows of about BATCH_WORDS words."""
    first, held, size = 0, [], 0
    for row, ids in enumerate(batch["ids"]):
        held.append(ids)
        size += len(ids)
        if size >= BATCH_WORDS:
            yield first, held
            first, held, size = row + 1, [], 0
    yield first, held


class Passages:
    """Sparse TF rows of the passages of a batch of documents: row, term and count per entry."""

    def __init__(self, documents: list[np.ndarray], weighty: np.ndarray) -> None:
        terms = len(weighty)
        sizes = np.fromiter(map(len, documents), dtype=np.int64, count=len(documents))
        windows = np.maximum(1, -(-(sizes - (WIDTH - STRIDE)) // STRIDE))
        self.first = np.cumsum(windows) - windows
        self.document = np.repeat(np.arange(len(documents)), windows)
        self.start = (np.arange(len(self.document)) - self.first[self.document]) * STRIDE
        flat = np.concatenate(documents).astype(np.int64) if len(documents) else np.empty(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(documents)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.r_[weighty, False][flat]  # -1, a word of no item, is the last entry
        flat, owner, place = flat[known], owner[known], place[known]
        last = place // STRIDE
        rows, cols = [], []
        for window in (last, last - 1):
            held = (window >= 0) & (window < windows[owner]) & (place - window * STRIDE < WIDTH)
            rows.append(self.first[owner[held]] + window[held])
            cols.append(flat[held])
        pairs, counts = np.unique(np.concatenate(rows) * terms + np.concatenate(cols), return_counts=True)
        self.row, self.term, self.count = pairs // terms, pairs % terms, counts

    def weighted(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) with rows of length one."""
        weights = (1 + np.log(self.count)) * idf[self.term]
        norms = np.sqrt(np.bincount(self.row, weights * weights, minlength=len(self.document)))
        return self.row, self.term, (weights / norms[self.row]).astype(np.float32)


def blocks_of(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first passage, terms, weights as a dense matrix over those terms) for CHUNK passages each.

    Few passages use few terms, so the matrices are small and multiply at full speed.
    """
    if not len(row):
        return
    edges = np.searchsorted(row, np.arange(row[0], row[-1] + CHUNK + 1, CHUNK))
    for a, b in zip(edges, edges[1:]):
        if b > a:
            terms, column = np.unique(term[a:b], return_inverse=True)
            dense = np.zeros((int(row[b - 1] - row[a]) + 1, len(terms)), dtype=np.float32)
            dense[row[a:b] - row[a], column] = weight[a:b]
            yield int(row[a]), terms, dense


def weighted_items(items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Items as dense rows of length one."""
    rows = np.zeros((len(items), len(idf)))
    for k, item in enumerate(items):
        terms, counts = np.unique(item, return_counts=True)
        rows[k, terms] = (1 + np.log(counts)) * idf[terms]
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def term_weights(counts: np.ndarray, total: int, items: list[np.ndarray]) -> np.ndarray:
    """Inverse document frequencies; zero for common terms that all their items can spare."""
    idf = np.log((1 + total) / (1 + counts)) + 1e-6
    common = counts > COMMON * total
    for item in items:
        if np.mean(~common[np.unique(item)]) < LEAST:
            common[item] = False
    return np.where(common, 0.0, idf)


def document_counts(terms: int) -> Callable:
    """Passages per term; the number of passages goes as term -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = np.zeros(terms, dtype=np.int64), 0
        for _, documents in (part for batch in batches for part in parts(batch)):
            passages = Passages(documents, np.ones(terms, dtype=bool))
            found += np.bincount(passages.term, minlength=terms)
            total += len(passages.document)
        used = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.r_[-1, used], "n": np.r_[total, found[used]]})

    return run


def sketches(idf: np.ndarray, start: np.ndarray) -> Callable:
    """Each partition's share of A^T (A start), in pieces of some terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(start.shape, dtype=np.float32)
        for _, documents in (part for batch in batches for part in parts(batch)):
            for _, terms, dense in blocks_of(*Passages(documents, idf > 0).weighted(idf)):
                total[terms] += dense.T @ (dense @ start[terms])
        # The same for a task that runs again, so that its pieces go where they went before.
        salt = TaskContext.get().partitionId() % SALTS
        pieces = range(0, len(total), TERM_ROWS)
        yield pd.DataFrame({"piece": list(pieces), "salt": salt, "data": [total[p : p + TERM_ROWS].tobytes() for p in pieces]})

    return run


def add_pieces(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["data"].iloc[0]) // 4, dtype=np.float64)
    for data in group["data"]:
        total += np.frombuffer(data, dtype=np.float32)
    return pd.DataFrame({"piece": group["piece"].iloc[:1], "salt": [0], "data": [total.astype(np.float32).tobytes()]})


def factors(sketch: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values from A^T A start (fixed-rank Nystrom, orthonormal start)."""
    shift = 1e-6 * np.linalg.norm(sketch)
    shifted = sketch + shift * start
    core = start.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-9 * values.max()
    vectors_, spread, _ = np.linalg.svd(shifted @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    squares = np.maximum(spread**2 - shift, 0)
    used = squares > 1e-9 * squares.max()
    return vectors_[:, used], np.sqrt(squares[used])


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    masks: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | (1 << k)
    full = (1 << len(item)) - 1
    state = full
    for word in region.tolist():
        mask = masks.get(word)
        if mask:
            held = state & mask
            state = ((state + held) | (state - held)) & full
    return len(item) - state.bit_count()


def contains(region: np.ndarray, item: np.ndarray) -> bool:
    if len(region) < len(item):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(region, len(item)) == item).all(axis=1).any())


def verified(item: np.ndarray, answer: np.ndarray, region: np.ndarray) -> tuple[float, float] | None:
    """(share of the item, share of the answer) in the region if it is a leak."""
    if len(item) < SHORT:
        return (1.0, 1.0) if contains(region, item) else None
    if np.isin(item, region).mean() < PARAPHRASED:  # a bound on the subsequence
        return None
    covered = common_subsequence(item, region) / len(item)
    if covered < PARAPHRASED:
        return None
    answered = common_subsequence(answer, region) / len(answer) if len(answer) else 0.0
    return (covered, answered) if covered >= COPIED or answered >= ANSWERED else None


def search(idf, space, items, answers, item_ids) -> Callable:
    rows = weighted_items(items, idf) @ space
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = (rows / np.where(norms > 0, norms, 1)).astype(np.float32)
    space = space.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].tolist()
            for first, documents in parts(batch):
                found = leaks_in(documents)
                rows_ = [(keys[first + owner], item_ids[k], *shares) for (owner, k), shares in found.items()]
                yield pd.DataFrame(rows_, columns=["key", "item_id", "covered", "answered", "cosine"])

    def leaks_in(documents: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """The best shares of each item in each document."""
        passages = Passages(documents, idf > 0)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for first, terms, dense in blocks_of(*passages.weighted(idf)):
            latent = dense @ space[terms]
            size = np.linalg.norm(latent, axis=1, keepdims=True)
            cosine = (latent / np.where(size > 0, size, 1)) @ rows.T
            for p, k in zip(*np.nonzero(cosine >= COSINE)):
                passage = first + p
                owner, start = int(passages.document[passage]), int(passages.start[passage])
                region = documents[owner][max(0, start - len(items[k])) : start + WIDTH + len(items[k])]
                leak = verified(items[k], answers[k], np.asarray(region))
                if leak:
                    found = (*leak, float(cosine[p, k]))
                    best[owner, k] = max(best.get((owner, k), found), found)
        return best

    return run


def _block_leaks(docs: DataFrame, rows: list) -> DataFrame:
    """Leaks in texts (key, text) for one block of benchmark items."""
    texts = [words_of(r["text"]) for r in rows]
    vocabulary = {word: k for k, word in enumerate(sorted({w for words in texts for w in words}))}
    items = [np.array([vocabulary[w] for w in words], dtype=np.int64) for words in texts]
    answers = []
    for r, item in zip(rows, items):
        own = [vocabulary.get(w, -1) for w in words_of(r["answer"])] if r["answer"] else item[-max(3, len(item) // 5) :]
        answers.append(np.asarray(own, dtype=np.int64))
    terms = len(vocabulary)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def ids_of(batch: pd.Series) -> pd.Series:
        by_text, rows = known.value, []
        by_bytes = {word.encode("utf-8"): k for word, k in by_text.items()}
        for text in batch:
            lower = (text or "").lower()
            if ODD.search(lower):
                words, get = WORD.findall(lower), by_text.get
            else:
                words, get = lower.encode("utf-8").translate(SEPARATED).split(), by_bytes.get
            rows.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words)))
        return pd.Series(rows, dtype=object)

    tokens = docs.select("key", F.pandas_udf(ids_of, "array<int>")("text").alias("ids"))
    tokens = stored(tokens, "benchmark-words")
    counts = tokens.select("ids").mapInPandas(document_counts(terms), "term long, n long")
    found = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(-1, 0)
    idf = term_weights(np.array([found.get(k, 0) for k in range(terms)]), total, items)
    own = weighted_items(items, idf)
    random = np.random.default_rng(11).standard_normal((terms, min(EXTRA, terms)))
    start = np.linalg.qr(np.c_[own.T, random])[0].astype(np.float32)
    pieces = tokens.select("ids").mapInPandas(sketches(idf, start), "piece int, salt int, data binary")
    for keys in (["piece", "salt"], ["piece"]):
        pieces = pieces.groupBy(*keys).applyInPandas(add_pieces, "piece int, salt int, data binary")
    sketch = np.zeros(start.shape)
    for r in pieces.collect():
        part = np.frombuffer(r["data"], dtype=np.float32).reshape(-1, start.shape[1])
        sketch[r["piece"] : r["piece"] + len(part)] = part
    mass = max(1, total) / len(items)
    sketch += mass * (own.T @ (own @ start))
    vectors, values = factors(sketch, start.astype(np.float64))
    # Directions that the corpus is full of count less; weak ones are not blown up.
    space = vectors / np.sqrt(values**2 + mass)
    run = search(idf, space, items, answers, [r["item_id"] for r in rows])
    return tokens.mapInPandas(run, LEAK)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, covered, answered, cosine): benchmark items found in documents.

    `covered` is the share of the item's words in the longest common subsequence with the words
    around the candidate passage, `answered` that of its answer: the column `answer` of the
    benchmark if there is one, else the item's last words. A document is listed once per item
    and row. Texts without words, null ones too, have no leaks; items without words are not
    searched. Rows with a null key are searched and listed under null.
    """
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.cast("string").alias("answer"))
    items = items.filter(F.col("text").rlike("[\\p{L}\\p{N}]"))
    kind = docs.schema[key].dataType
    named = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    blocks = math.ceil(items.count() / ITEMS)
    result = docs.sparkSession.createDataFrame([], LEAK)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        rows = [r for r in part if words_of(r["text"])]
        if rows:
            result = result.union(_block_leaks(named, rows))
    return result.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, unchanged and with the same columns.

    Decided by text, so rows without a key or with a repeated one are treated like any other.
    """
    name = F.concat_ws(":", F.xxhash64(F.col(text)), F.hash(F.col(text)))
    found = leaks(docs.select(name.alias("name"), F.col(text).alias("text")), benchmark, key="name")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    return rows.join(stored(found.select("name").distinct(), "leaks"), "name", "left_anti").select("row.*")
