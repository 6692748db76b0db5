"""Exact top-k by inner product with pivot-table elimination.

Every vector carries its distances to a set of pivots, computed once. By the triangle
inequality the distance of a query and a candidate is at least the largest difference of
their table rows, and with both norms known that bounds the inner product from above.
Candidates are taken in the order of that bound until it falls below the k-th best score.

Queries and candidates are dealt into numbered blocks, and each pair of blocks is one group:
a block of candidates meets all queries without a cross join, and no task holds more than one
block of each. The best k of each group meet in a second, small step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

PIVOTS = 32
PIVOT_ROWS = 4096  # rows of the sample that pivots are picked from; any pivots give the same result
CANDIDATES, QUERIES = 2048, 4096  # rows of a block
CHUNK = 128  # candidates scored before the first look at the bound
EXACT = 2**53  # integers below are exact as doubles


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the row farthest from those so far."""
    chosen = [0]
    distance = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def pivot_distances(pivots: dict[int, np.ndarray]):
    """A Pandas UDF: vector to its distances to the pivots of its length."""

    def run(vectors: pd.Series) -> pd.Series:
        rows = []
        for vector in vectors:
            own = pivots.get(len(vector))
            rows.append(np.linalg.norm(own - np.asarray(vector, dtype=np.float64), axis=1) if own is not None else np.zeros(1))
        return pd.Series(rows)

    return F.pandas_udf(run, "array<double>")


class Block:
    """Candidates of one length with what is computed once for all queries that meet them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, tables: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.values = rows.astype(np.float64)
        self.tables = np.ascontiguousarray(tables.T)  # a row per pivot
        self.squares = np.square(self.values).sum(axis=1)
        self.most = float(np.abs(self.values).max())

    def upper(self, query: np.ndarray, table: np.ndarray) -> np.ndarray:
        """At least the inner product with each candidate. Slack for rounding only costs an evaluation."""
        lower = np.abs(self.tables - table[:, None]).max(axis=0)
        lower = np.maximum(lower * (1 - 1e-9) - 1e-6, 0)
        sums = float(query @ query) + self.squares
        return (sums - lower * lower) / 2 + (1 + 1e-9 * sums)

    def inner(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: as doubles where they fit, else as Python integers."""
        if self.most * float(np.abs(query).max()) * len(query) < EXACT:
            return (self.values[places] @ query.astype(np.float64)).astype(np.int64)
        products = self.rows[places].astype(object) @ query.astype(object)
        return np.array([min(max(int(p), -(2**63)), 2**63 - 1) for p in products], dtype=np.int64)

    def best(self, own: int, query: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, ties to the smaller id.

        Taken in the order of the bound, in growing chunks: what cannot reach the k-th best
        score so far is discarded, and the search ends when nothing is left.
        """
        upper = self.upper(query.astype(np.float64), table)
        left = np.flatnonzero(self.ids != own)
        ids, scores, size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), CHUNK
        while len(left):
            if len(left) > size:
                split = np.argpartition(-upper[left], size)
                chunk, left = left[split[:size]], left[split[size:]]
            else:
                chunk, left = left, left[:0]
            ids, scores = np.concatenate([ids, self.ids[chunk]]), np.concatenate([scores, self.inner(chunk, query)])
            if len(scores) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= least], scores[scores >= least]
                left = left[upper[left] >= least]
            size *= 4
        keep = np.lexsort((ids, -scores))[:k]
        return ids[keep], scores[keep]


def search_blocks(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for _, part in group.groupby(group["vector"].map(len)):
            mine, others = part[part["is_query"]], part[~part["is_query"]]
            if mine.empty or others.empty:
                continue
            block = Block(others["id"].to_numpy(), np.stack(others["vector"].to_numpy()), np.stack(others["distances"].to_numpy()))
            for own, query, table in zip(mine["id"].tolist(), mine["vector"], mine["distances"]):
                found.append((own, *block.best(own, np.asarray(query), np.asarray(table), k)))
        empty = np.empty(0, dtype=np.int64)
        return pd.DataFrame({
            "query_id": np.repeat(np.array([own for own, _, _ in found], dtype=np.int64), np.array([len(ids) for _, ids, _ in found], dtype=np.int64)),
            "vec_id": np.concatenate([empty, *(ids for _, ids, _ in found)]),
            "score": np.concatenate([empty, *(scores for _, _, scores in found)]),
        })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which `is_query` holds.

    Components are floor(scale * x); scores are integer inner products, higher first, ties to
    the smaller id. A row whose vector is null, empty or holds a null or non-finite component
    takes no part, nor does one with a null id. Only vectors of one length are compared. A
    query never meets rows of its own id; a repeated query counts once and a repeated candidate
    as often as it is there. Scores beyond 64 bits saturate. Fewer than k candidates give fewer rows.
    """
    rows = vectors.filter(F.col(id_column).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sample = rows.select("vector").orderBy(F.xxhash64("id")).limit(PIVOT_ROWS).toPandas()["vector"]
    pivots = {}
    for size, part in sample.groupby(sample.map(len)):
        pivots[int(size)] = pick_pivots(np.stack(part.to_numpy()).astype(np.float64), PIVOTS)
    rows = stored(rows.withColumn("distances", pivot_distances(pivots)("vector")), "pivot-tables")
    n, q = rows.agg(F.count("*"), F.count_if("is_query")).first()
    n_blocks, q_blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(q / QUERIES))

    def dealt(frame: DataFrame, flag: bool, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        return frame.select(
            F.lit(flag).alias("is_query"), "id", "vector", "distances",
            F.pmod(F.xxhash64("id"), F.lit(own)).alias(own_name), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(other_name),
        )

    candidates = dealt(rows, False, n_blocks, q_blocks, "c", "q")
    queries = dealt(rows.filter("is_query").dropDuplicates(["id", "vector"]), True, q_blocks, n_blocks, "q", "c")
    blocks = candidates.unionByName(queries).groupBy("c", "q")
    best = blocks.applyInPandas(search_blocks(k), "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
