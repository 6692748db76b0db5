"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

Texts are split by the tokenizer's pattern. The different pieces of a batch are padded into
matrices of similar length, one row each. In every round each row merges its leftmost pair of
minimum rank: the rank matrix gives the place, the columns behind it move up by one, and only
the two pairs at the new token are looked up again, in a hash table of pairs. Rows without a
pair left to merge are written out and the matrix is compacted.

A piece longer than the widest matrix would take as many rounds as it has bytes, so it is
merged with a heap instead; the order of merges is the same.

The rank file's path is a parameter. Each Python worker reads it once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = [4, 8, 12, 16, 24, 32, 64]
NONE = np.iinfo(np.int32).max
BATCH_CHARS = 2_000_000  # texts worked on at once
CACHED = 300_000  # pieces that a worker remembers

# Letters, numbers and spaces below U+0250: for such texts the standard module is twice as fast.
NEAR = {"L": "A-Za-zªµºÀ-ÖØ-öø-ɏ", "N": "0-9²³¹¼½¾", "S": "\t-\r \x85\xa0"}
FAR = re.compile("[ɐ-\U0010ffff]")


class PairTable:
    """(left, right) -> merged token, by open addressing in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(merged) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = self.key(left, right)
        slots = self.slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == -1
            # Of several keys for one free slot the first takes it; the others move on.
            _, first = np.unique(slots[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged tokens; NONE where the pair does not merge or a side is padding."""
        keys = self.key(left, right)
        slots = self.slot(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        found[(left < 0) | (right < 0)] = NONE
        return found


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items() for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.full = regex.compile(pattern)
        near = pattern.replace(r"\p{L}", NEAR["L"]).replace(r"\p{N}", NEAR["N"])
        near = near.replace(NEAR["L"] + "+", f"[{NEAR['L']}]+", 1).replace(" ?" + NEAR["N"] + "+", f" ?[{NEAR['N']}]+", 1)
        near = near.replace(r"[^\s", f"[^{NEAR['S']}").replace(r"\S", f"[^{NEAR['S']}]").replace(r"\s", f"[{NEAR['S']}]")
        self.near = re.compile(near)
        self.known: dict[str, int] = {}
        self.starts = self.sizes = self.flat = np.empty(0, dtype=np.int64)

    def pieces(self, text: str) -> list[str]:
        return self.full.findall(text) if FAR.search(text) else self.near.findall(text)

    def merge_rows(self, rows: list[bytes], width: int) -> np.ndarray:
        """Token ids of each row, padded with -1."""
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        done = np.full_like(ids, -1)
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        alive = np.arange(len(rows))
        while len(alive):
            place = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(alive), dtype=np.int64)
            best = ranks[np.arange(len(alive)), place] if ranks.shape[1] else np.full(len(alive), NONE, dtype=np.int32)
            ended = best == NONE
            if ended.any():
                done[alive[ended], : ids.shape[1]] = ids[ended]
                alive, ids, ranks, place, best = (x[~ended] for x in (alive, ids, ranks, place, best))
                if not len(alive):
                    break
            at, columns = np.arange(len(alive)), np.arange(ids.shape[1] - 1)
            behind = columns > place[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[at, place] = best
            behind = columns[:-1] > place[:, None]
            ranks = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            right = place < ranks.shape[1]
            ranks[at[right], place[right]] = self.pairs.find(best[right], ids[at[right], place[right] + 1])
            left = place > 0
            ranks[at[left], place[left] - 1] = self.pairs.find(ids[at[left], place[left] - 1], best[left])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        parts = [piece[k : k + 1] for k in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(place: int) -> None:
            if place >= 0 and after[place] < len(ids):
                other = after[place]
                rank = self.ranks.get(parts[place] + parts[other])
                if rank is not None:
                    heapq.heappush(heap, (rank, place, ids[place], ids[other]))

        for place in range(len(ids) - 1):
            offer(place)
        while heap:
            rank, place, left, right = heapq.heappop(heap)
            other = after[place]
            if ids[place] != left or other >= len(ids) or ids[other] != right:
                continue
            parts[place] += parts[other]
            ids[place], ids[other], after[place] = rank, -1, after[other]
            if after[place] < len(ids):
                before[after[place]] = place
            offer(before[place])
            offer(place)
        return [i for i in ids if i >= 0]

    def learn(self, fresh: list[str]) -> None:
        """Encode pieces that are not known yet and append them to the flat table."""
        data = [piece.encode("utf-8") for piece in fresh]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        bucket = np.searchsorted(WIDTHS, sizes)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, width in enumerate(WIDTHS):
            own = np.flatnonzero(bucket == k)
            if len(own):
                ids = self.merge_rows([data[i] for i in own], width)
                rows.append((own, (ids >= 0).sum(axis=1), ids[ids >= 0].astype(np.int64)))
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            ids = np.array(self.merge_long(data[i]), dtype=np.int64)
            rows.append((np.array([i]), np.array([len(ids)]), ids))
        at = len(self.flat)
        starts, counts = np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=np.int64)
        for own, lengths, ids in rows:
            starts[own], counts[own] = at + np.cumsum(lengths) - lengths, lengths
            at += len(ids)
        self.flat = np.concatenate([self.flat, *(ids for _, _, ids in rows)])
        first = len(self.known)
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, counts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED:
            self.known, self.starts, self.sizes, self.flat = {}, *(np.empty(0, dtype=np.int64) for _ in range(3))
        split = [self.pieces(text) for text in texts]
        fresh = set().union(*split).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        found = []
        for pieces in split:
            which = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            sizes = self.sizes[which]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.arange(total) + np.repeat(self.starts[which] - (ends - sizes), sizes)
            found.append(self.flat[places].astype("<u4"))
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist()))

    def batches(self, texts: pd.Series) -> Iterator[np.ndarray]:
        """Ids of each text in turn; a null counts as empty."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= BATCH_CHARS:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of `docs` with an array<int> of token ids; a null or empty text has none.

    Texts are encoded whole, without special tokens. An existing column `ids` is replaced.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([row.astype(np.int32) for row in codec(path, pattern).batches(texts)], dtype=object)

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """The rows of `docs` with the bytes of their ids; null ids have no bytes."""

    def run(rows: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([own.decode(row) if row is not None else b"" for row in rows], dtype=object)

    return docs.withColumn(data, F.pandas_udf(run, "binary")(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with struct column `tokens`: count and digest of the ids, and the
    digest of the bytes that decoding those ids gives. The ids stay in the worker."""

    def run(texts: pd.Series) -> pd.DataFrame:
        own = codec(path, pattern)
        rows = [
            (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
            for ids in own.batches(texts)
        ]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("tokens", F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text)))


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """The rows of `docs` with struct column `tokens`: the ids, their number, and whether
    decoding them gives the text back byte for byte."""

    def run(texts: pd.Series) -> pd.DataFrame:
        own = codec(path, pattern)
        rows = [
            (ids.astype(np.int32), len(ids), own.decode(ids) == (text or "").encode("utf-8"))
            for text, ids in zip(texts, own.batches(texts))
        ]
        return pd.DataFrame(rows, columns=["ids", "n_tokens", "restored"])

    return docs.withColumn(name, F.pandas_udf(run, "ids array<int>, n_tokens long, restored boolean")(F.col(text)))
