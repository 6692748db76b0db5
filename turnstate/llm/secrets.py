"""Secret scans: keyword automaton, anchored patterns at its hits, checksum validation.

An Aho-Corasick automaton finds the keywords of every kind in one pass over the text. A
pattern is tried only where a keyword begins, so a text without hits costs one pass. Runs of
hexadecimal digits have no keyword; they are found by a second automaton over the text with
every such digit mapped to one symbol, where 24 of that symbol are the keyword.

All keywords and patterns are ASCII, so texts are scanned as UTF-8 bytes and only the ends
of what is found are counted in code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds every scan reports, in listing order.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

# Token formats whose last six characters are the CRC-32 of the body in base 62.
CRC_PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CRC_BODY, CRC_DIGITS = 30, 6
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Extended private keys end in four bytes of a double SHA-256.
XPRV_PREFIX, XPRV_LENGTH = "xprv", 111
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "crc", "xprv"]

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_validated long"

_HEX_RUN = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


def crc_token_ok(token: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the thirty before them."""
    body, digits = token[-CRC_BODY - CRC_DIGITS : -CRC_DIGITS], token[-CRC_DIGITS:]
    value = zlib.crc32(body)
    for digit in reversed(digits):
        value, rest = divmod(value, 62)
        if BASE62[rest] != digit:
            return False
    return value == 0


def base58_ok(key: bytes) -> bool:
    """Whether a base-58 text ends in the first four bytes of its payload's double SHA-256."""
    number = 0
    for char in key:
        number = number * 58 + BASE58.index(char)
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    payload, check = raw[:-4], raw[-4:]
    return hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4] == check


class Scanner:
    """The automata and patterns; one per task."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            self.words.add_word(word, ("assign", len(word)))
        self.words.add_word("akia", ("access", 4))
        for word in CRC_PREFIXES:
            self.words.add_word(word, ("crc", len(word)))
        self.words.add_word(XPRV_PREFIX, ("xprv", len(XPRV_PREFIX)))
        self.words.make_automaton()
        self.runs = ahocorasick.Automaton()
        self.runs.add_word("h" * HEX_MIN, HEX_MIN)
        self.runs.make_automaton()
        self.pattern = {
            "assign": re.compile(ASSIGN, re.IGNORECASE),
            "access": re.compile(ACCESS),
            "hex": re.compile(HEX),
            "crc": re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
            "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{%d}(?![A-Za-z0-9])" % (XPRV_LENGTH - len(XPRV_PREFIX))),
        }

    def kept(self, kind: str, match: re.Match[bytes]) -> bool:
        if kind == "assign":
            return len(match[2]) >= ASSIGN_MIN
        if kind == "access":
            return len(match[0]) >= ACCESS_MIN
        if kind == "hex":
            return len(match[0]) >= HEX_MIN
        return crc_token_ok(match[0]) if kind == "crc" else base58_ok(match[0])

    def hits(self, data: bytes) -> Iterator[tuple[str, int]]:
        """Places where a match may begin, ascending within a kind. latin-1 keeps byte positions."""
        for end, (kind, size) in self.words.iter(data.lower().decode("latin-1")):
            yield kind, end - size + 1
        for end, size in self.runs.iter(data.translate(_HEX_RUN).decode("latin-1")):
            yield "hex", end - size + 1

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes. A match uses up its text whether it is kept or not."""
        found, free = [], dict.fromkeys(KINDS, 0)
        for kind, start in self.hits(data):
            if start < free[kind]:
                continue
            if match := self.pattern[kind].match(data, start):
                free[kind] = match.end()
                if self.kept(kind, match):
                    found.append((start, KINDS.index(kind), match.end()))
        return sorted(found)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points: continuation bytes do not count."""
    if data.isascii() or not spans:
        return spans
    place, at, count = {}, 0, 0
    for position in sorted({p for start, _, end in spans for p in (start, end)}):
        count += len(data[at:position].decode("utf-8"))
        at = position
        place[position] = count
    return [(place[start], kind, place[end]) for start, kind, end in spans]


def scan_texts(texts: pd.Series) -> pd.DataFrame:
    scanner, rows = Scanner(), []
    for text in texts:
        data = (text or "").encode("utf-8")
        spans = in_code_points(data, scanner.spans(data))
        counts = [sum(kind == k for _, kind, _ in spans) for k in range(len(KINDS))]
        base = ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans if kind < len(BASE_KINDS))
        every = ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
        rows.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), every, sum(counts[3:])))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_validated"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with a struct column `secrets`.

    It holds the number of spans per base kind, the digest of the base spans, all spans as
    `kind:start:end` and the number of spans whose embedded checksum was right. Only the text
    column goes to Python. A null text counts as empty; a text without secrets has counts of
    zero, the digest of an empty string and no spans. Repeated rows give repeated results, and
    an existing column `secrets` is replaced.
    """
    return docs.withColumn("secrets", F.pandas_udf(scan_texts, SCHEMA)(F.col(text)))
