"""URL filters: explicit host and path rules, then a path-template tree judged by its labels.

The tree is grown per host and level by level. Numbers and long hexadecimal runs in a segment
are wildcards from the start, which folds most paths together before anything is shuffled. At
each node, segments that few urls share become one wildcard branch (`*`); well-supported
segments whose share of bad labels does not differ from their siblings' are merged into one
branch (`+`); what is left keeps its name. A template is rejected when the share of good
labels among its urls, smoothed towards the share over all urls, is too low.

The tree holds one row per host and masked path. A page finds its template by a join that
adaptive execution can split, so a host with a third of all pages is no special case.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

LEVELS = 8  # segments below share one tail wildcard
MIN_ROWS = 20  # urls that a segment needs for a branch of its own, however many its siblings have
SIMILAR_Z = 1.96  # below: two branches do not differ
PRIOR_ROWS = 20  # weight of the overall share in the smoothed purity
MIN_PURITY = 0.7

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and the path; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule string, action) of the longest rule that fits, or nulls."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        action = F.when(fits, rule.action).otherwise(action)
    return name, action


def masked_path(path: Column) -> Column:
    """Long hexadecimal runs, then numbers, as wildcards."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}")


def _grown(tree: DataFrame, level: int) -> DataFrame:
    """The tree with one more segment of its templates decided. Paths that have ended stay."""
    child = F.when(F.size("segments") >= level, F.element_at("segments", level))
    tree = tree.withColumn("child", child)
    kids = tree.filter("child is not null").groupBy("host", "template", "child").agg(
        *[F.sum(c).alias(c) for c in ("urls", "labelled", "bad")]
    )
    nodes = kids.groupBy("host", "template").agg(
        F.count("*").alias("kids"), F.sum("urls").alias("all_urls"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    rest = F.col("all_labelled") - F.col("labelled")
    share, pooled = F.col("bad") / F.col("labelled"), F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
    apart = F.abs(share - (F.col("all_bad") - F.col("bad")) / rest)
    differs = F.when((F.col("labelled") > 0) & (rest > 0), apart > SIMILAR_Z * error).otherwise(False)
    # A segment that looks like a wildcard is written with a mark before it.
    child = F.when(F.col("child").rlike(r"^[\\*+]"), F.concat(F.lit("\\"), "child")).otherwise(F.col("child"))
    branch = F.when(F.col("kids") == 1, child).when(F.col("urls") < MIN_ROWS, "*").when(differs, child).otherwise("+")
    chosen = kids.join(nodes, ["host", "template"]).select("host", "template", "child", branch.alias("branch"))
    grown = tree.join(chosen, ["host", "template", "child"], "left")
    template = F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat_ws("/", F.nullif(F.col("template"), F.lit("\u0000")), "branch"))
    return grown.withColumn("template", template).drop("child", "branch")


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, masked, template, labelled, bad) for rows of (host, masked, bad), bad null where unlabelled."""
    tree = urls.groupBy("host", "masked").agg(
        F.count("*").alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    parts = F.split("masked", "/", -1)
    parts = F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.lit("{tail}")))).otherwise(parts)
    # A template starts as a mark that no path holds, so that an empty first segment still counts.
    tree = stored(tree.withColumn("segments", parts).withColumn("template", F.lit("\u0000")), "paths")
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, deepest + 1):
        tree = stored(_grown(tree, level), "paths")
    return tree.drop("segments")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", bad: str = "bad") -> DataFrame:
    """The rows of `pages` with struct column `judged`: (host, path, rule, template, purity, verdict).

    `bad` is 0 or 1 for labelled pages and null for others. Null urls and urls without `://`
    have an empty host and path and share the template of those. Repeated rows count once
    each. A template without labels has the overall purity and is not rejected. Existing columns keep their
    values; a column `judged` is replaced.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.drop("judged").select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "judged"]).alias("row"), F.col(bad).alias("bad"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("masked", masked_path(F.col("path")))
    tree = path_templates(rows.select("host", "masked", "bad"))
    labelled, wrong = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (wrong or 0) / labelled if labelled else 0.0
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = 1 - (F.col("bad") + F.lit(PRIOR_ROWS * prior)) / (F.col("labelled") + PRIOR_ROWS)
    rejected = (purity < MIN_PURITY) & (F.col("labelled") > 0)
    leaves = leaves.select("host", "template", purity.alias("purity"), rejected.alias("rejected"))
    verdicts = tree.select("host", "masked", "template").join(leaves, ["host", "template"])
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("rejected"), "block").otherwise("allow"))
    judged = F.struct("host", "path", rule.alias("rule"), "template", "purity", verdict.alias("verdict"))
    return rows.drop("bad").join(verdicts, ["host", "masked"]).select("row.*", judged.alias("judged"))
