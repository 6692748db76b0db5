"""Filter interaction audit: what each filter removes, in every order of the filters.

Which filters a document fails is one of 2^5 cells. Spark counts the documents of every cell, per
part of the corpus; a part's counts, reshaped to 2x2x2x2x2, are a contingency tensor with one axis
per filter. Every figure of every step of every order is then a contraction of that tensor: along
each axis it takes the documents that pass, those that fail, or all. Only cell counts reach Python.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the five conditions a document fails by.
LETTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"
FEW_WORDS = 200
SIGNS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D, which a text alone decides; null counts as empty.

    A: under 200 words. B: under half of the words differ. C: over 3 % of the code points are
    capitals. D: holds a sign.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORDS), F.lit(0))
    capitals = F.length(whole) - F.length(F.translate(whole, UPPER, ""))
    return [
        F.size(words) < FEW_WORDS,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals * 100 > F.length(whole) * 3,
        whole.rlike(SIGNS),
    ]


def cell_counts(docs: DataFrame, labels: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """(part, cell, docs, good, toxic): documents per combination of failed filters.

    A's bit is the highest. E, identical to the text of a smaller key anywhere in the table, is
    decided on the SHA-256 of the text: rows of one text are counted by what they have in common,
    and all but those of its smallest key fail. A group of copies is so reduced before any shuffle.
    """
    bits = [F.when(c, 1 << (4 - k)).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))]
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    source = source.select("key", "part", digest.alias("digest"), reduce(lambda a, b: a + b, bits).alias("cell"))
    rows = source.groupBy("key", "part", "digest", "cell").agg(F.count("*").alias("docs"))
    # Null keys have no label; a hash in their place spreads them, and `none` keeps them apart.
    none = F.col("key").isNull()
    joint = F.coalesce(F.col("key").cast("string"), F.hex("digest"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("joint")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    rows = rows.withColumns({"none": none, "joint": joint}).join(known.withColumn("none", F.lit(False)), ["none", "joint"], "left")
    marks = [F.coalesce(m, F.lit(0)).alias(m) for m in ("good", "toxic")]
    same = ["digest", "part", "cell", "good", "toxic"]
    first = F.min(F.when(~F.col("none"), F.struct("key", "docs"))).alias("first")
    unnamed = F.sum(F.when(F.col("none"), F.col("docs")).otherwise(0)).alias("unnamed")
    alike = rows.select("key", "none", "docs", "digest", "part", "cell", *marks).groupBy(*same)
    alike = alike.agg(F.sum("docs").alias("docs"), unnamed, first)
    # A text has few kinds of rows: one per part and combination of labels.
    kinds = F.collect_list(F.struct(*same[1:], "docs", "unnamed", "first")).alias("kinds")
    texts = alike.groupBy("digest").agg(F.min("first.key").alias("least"), kinds)
    kinds = texts.select("least", F.explode("kinds").alias("kind")).select("least", "kind.*")
    smallest = F.when(F.col("first.key") == F.col("least"), F.col("first.docs")).otherwise(0)
    kinds = kinds.withColumn("passed", F.col("unnamed") + smallest)
    both = F.array(
        F.struct(F.col("cell").alias("cell"), F.col("passed").alias("docs")),
        F.struct((F.col("cell") + 1).alias("cell"), (F.col("docs") - F.col("passed")).alias("docs")),
    )
    cells = kinds.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.*")
    return cells.groupBy("part", "cell").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic")
    )


def selectors() -> tuple[list[str], np.ndarray, np.ndarray]:
    """For every order and step: its label, its letter, and what kept and removed take along each axis."""
    orders, letters, kept, removed = [], [], [], []
    for order in itertools.permutations(range(5)):
        for step, axis in enumerate(order):
            before = set(order[:step])
            orders.append("".join(LETTERS[k] for k in order))
            letters.append(axis)
            kept.append([PASS if k in before or k == axis else ALL for k in range(5)])
            removed.append([FAIL if k == axis else PASS if k in before else ALL for k in range(5)])
    return orders, np.array(letters), np.array([kept, removed], dtype=np.int64)


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of each tensor under each choice of pass, fail or all along the five axes."""
    axes = [chosen[:, k, :] for k in range(5)]
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensors, *axes, optimize=True)


def audit_part(cells: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from the counts of its cells."""
    tensors = np.zeros((3, 32), dtype=np.int64)
    for k, name in enumerate(("docs", "good", "toxic")):
        np.add.at(tensors[k], cells["cell"].to_numpy(), cells[name].to_numpy())
    tensors = tensors.reshape(3, 2, 2, 2, 2, 2)
    orders, axis, (kept, removed) = selectors()
    lost = contract(tensors, removed)
    single = np.array([[FAIL if k == a else ALL for k in range(5)] for a in range(5)])
    alone = np.array([[FAIL if k == a else PASS for k in range(5)] for a in range(5)])
    fails, only = contract(tensors[:1], single)[0], contract(tensors[:1], alone)[0]
    shapley = np.array([lost[0][axis == a].sum() for a in range(5)])
    figures = [contract(tensors[:1], kept)[0], lost[0], fails[axis] - lost[0], only[axis], lost[1], lost[2], shapley[axis]]
    rows = {"part": cells["part"].iloc[0], "filter_order": orders, "step": np.tile(np.arange(1, 6, dtype=np.int32), 120)}
    return pd.DataFrame({**rows, **dict(zip(COUNTS, figures))})


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per value of `part` (null: empty string), each of the 120 orders and each step; an
    empty table has no parts. `labels` holds (doc_id, quality, toxic); of repeated labels of one
    document the highest counts, a document without any is neither good nor toxic. Rows with a
    null key have no smaller one and pass E. Repeated rows are documents of their own; those that
    repeat a text's smallest key all pass E.
    """
    return cell_counts(docs, labels, part, key, text).groupBy("part").applyInPandas(
        audit_part, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    )
