"""Text columns: tokens, trims, excerpts, stable digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token class and the three quality-gate patterns.
TOKEN_PATTERN = "[a-z0-9']+"
BANNED_PATTERN = "(as an ai|language model|i cannot|i can't provide)"
ASK_PATTERN = "(recommend|choose|pick|what would you|your recommendation|just tell me|if you had to pick)"
HANDOVER_PATTERN = "(just decide|you choose|pick for me)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    """Cut every kind of white space at both ends; `trim` would only cut spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def lexical_diversity(words: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(words)), F.size(words))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True where any phrase is a substring; no word boundaries."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def digit(digest: Column, index: int, size: int) -> Column:
    """A number in [0, size) from the index-th byte of a hex digest."""
    byte = F.conv(F.substring(digest, 1 + 2 * index, 2), 16, 10).cast("bigint")
    return byte % F.lit(size)


def stable_index(key: Column, size: Column) -> Column:
    """A number in [0, size) that depends on the key alone."""
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (number % size.cast("bigint")).cast("int")


def one_of(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
