"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: token count, then the leading tokens (numbers masked), then the
templates of that leaf. In a leaf, a token position is variable if its tokens are about as
many as the leaf's different lines; the other positions are constant. Lines of a leaf with
the same constant tokens share a template, provided that enough positions are constant; else
a line is its own template. A template found in more than one document recurs, and its lines
are dropped from every document but the first, so no text leaves the corpus altogether.

Tokens are separated by single spaces, lines by newlines. Statistics are counts, minima and
maxima, combined before every shuffle; whole lines are shuffled only where their leaf holds
more than one document. No group is gathered: a list per leaf has one entry per token position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

LEADING = 3
CONSTANT = 0.8  # share of constant positions that a template needs
VARIABLE = 0.5  # different tokens per different line from which a position is variable
WILD = "<*>"


def masked(text: Column) -> Column:
    """Numbers replaced by a wildcard."""
    return F.regexp_replace(text, "[0-9]+", WILD)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def identity(text: Column) -> Column:
    """Two hashes of different families: 96 bits."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("h"))


def lines_of(docs: DataFrame, leading: int) -> DataFrame:
    """(doc, line, leaf) for every line that is not blank."""
    lines = docs.select("doc", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.trim("line") != "")
    leads = masked(F.substring_index("line", " ", leading))
    leaf = F.struct(token_count(F.col("line")).alias("n"), identity(leads).alias("lead"))
    return lines.select("doc", "line", leaf.alias("leaf"))


def recurring_lines(docs: DataFrame, leading: int, constant: float) -> DataFrame:
    """(doc, line hash) of the lines to drop, for rows of (doc, text)."""
    lines = lines_of(docs, leading)
    shared = lines.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("leaf")
    rows = lines.join(stored(shared, "leaves"), "leaf", "left_semi").select(
        "doc", "leaf", F.xxhash64("line").alias("line_hash"), masked(F.col("line")).alias("pattern")
    )
    rows = stored(rows.withColumn("variant", identity(F.col("pattern"))), "lines")

    # The different lines of each leaf, and which documents they are in.
    variants = stored(
        rows.groupBy("leaf", "variant").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("pattern").alias("pattern")
        ),
        "variants",
    )
    several = variants.groupBy("leaf").agg(F.count("*").alias("variants")).filter("variants > 1")

    # Per leaf, a mask of its variable positions.
    tokens = variants.join(several, "leaf", "left_semi").select("leaf", F.posexplode(F.split("pattern", " ", -1)).alias("pos", "token"))
    counts = tokens.groupBy("leaf", "pos", "token").agg(F.count("*").alias("n"))
    places = counts.groupBy("leaf", "pos").agg(F.sum("n").alias("lines"), F.count("*").alias("tokens"))
    places = places.withColumn("open", (F.col("tokens") > 1) & (F.col("tokens") >= VARIABLE * F.col("lines")))
    masks = places.groupBy("leaf").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "open"))), lambda p: p["open"]).alias("mask"),
        F.sum(F.col("open").cast("long")).alias("open"),
    ).filter(F.col("open") <= (1 - constant) * F.col("leaf.n"))

    # A variant's template: its tokens at the constant positions, or itself.
    general = F.array_join(
        F.zip_with(F.split("pattern", " ", -1), "mask", lambda t, m: F.when(m, WILD).otherwise(t)), " "
    )
    placed = variants.join(masks.select("leaf", "mask"), "leaf", "left").select(
        "leaf", "variant", "first", "last",
        F.when(F.col("mask").isNull(), F.col("variant")).otherwise(identity(general)).alias("template"),
    )
    placed = stored(placed, "templates")
    repeated = placed.groupBy("leaf", "template").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
    keeps = placed.select("leaf", "variant", "template").join(repeated, ["leaf", "template"]).select("leaf", "variant", "first")
    return rows.join(keeps, ["leaf", "variant"]).filter(F.col("doc") != F.col("first")).select("doc", "line_hash")


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", leading: int = LEADING, constant: float = CONSTANT) -> DataFrame:
    """The rows of `docs` without the lines whose template an earlier document has.

    "Earlier" is by `key`; lines that repeat inside one document only stay, and so do blank
    lines. All other columns are unchanged, whatever their names. A document that loses every
    line stays with an empty text. A null or empty text stays as it is. Rows with a null key
    stay as they are and do not count as documents; rows that repeat a key are one document.
    """
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    found = recurring_lines(source, leading, constant).groupBy("doc").agg(F.collect_set("line_hash").alias("dropped"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("doc"))
    joined = rows.join(found, "doc", "left")
    old = F.col("row").getField(text)
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda line: (F.trim(line) == "") | ~F.array_contains("dropped", F.xxhash64(line))), "\n")
    new = F.when(F.col("dropped").isNull(), old).otherwise(kept)
    return joined.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
