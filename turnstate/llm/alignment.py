"""Cross-tokenizer alignment between whitespace-token anchors.

Both tokenizers encode a whole text. An anchor is a byte offset at which tokens of both end and
the next token of both is marked with a space; that the ends are shared is checked on the bytes.
Anchors split a document into windows of token ids, mostly one word each. What happens inside a
window depends on its ids alone, so its alignment is worked out once and remembered by the pair
of id tuples.

For the counts over the corpus a task gathers documents into chunks and passes on each different
pair of a chunk once, with how often it occurs. Pair counts are aggregated from these and joined
back to the pairs of each chunk, and a chunk's documents look them up there. No table of all
pairs is broadcast, and a document's links are never rows of their own.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.llm.tables import stored
from turnstate.llm.vocabularies import ByteLevelEncoder, PieceEncoder

CHUNK_TOKENS = 4_000_000  # tokens of both kinds from which a chunk of documents is complete
MEMO_TOKENS = 4_000_000  # ids in remembered windows; beyond that the next chunk begins a new memo
ENCODED_CHARS = 500_000  # characters encoded at a time

# A window is its pair of id tuples packed as bytes: 4 for each id, those of the second kind with
# the highest bit set.
Window = bytes
SECOND = 1 << 31


class Windows:
    """Both tokenizers, and the alignments of the windows seen so far."""

    def __init__(self, byte_level: str, sentence_pieces: str) -> None:
        self.encoders = ByteLevelEncoder(byte_level), PieceEncoder(sentence_pieces)
        self.bytes = [e.token_bytes() for e in self.encoders]
        self.sizes = [np.array([len(b) for b in table], dtype=np.int64) for table in self.bytes]
        self.lengths = [sizes.tolist() for sizes in self.sizes]
        self.names = [[str(k) for k in range(len(table))] for table in self.bytes]
        self.spaced = [np.array([b[:1] == b" " for b in table]) for table in self.bytes]
        self.forget()

    def forget(self) -> None:
        """Begin a new memo, and with it a new numbering of pairs."""
        self.memo: dict[Window, tuple[str, bytes]] = {}
        self.pairs: dict[int, int] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both kinds, or None where the bytes of either are not a space and the text."""
        both = zip(texts, self.encoders[0].encode([" " + t for t in texts]), self.encoders[1].encode(texts))
        return [self._whole(" " + text, ids) if text else None for text, *ids in both]

    def _whole(self, text: str, ids: list[list[int]]):
        data = text.encode("utf-8")
        same = all(b"".join(map(table.__getitem__, own)) == data for table, own in zip(self.bytes, ids))
        return tuple(ids) if same else None

    def cut(self, a: list[int], b: list[int]) -> list[Window]:
        """The windows of a document between its anchors."""
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        ends_a, ends_b = (np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (x, y)))
        found = np.searchsorted(ends_b, ends_a[:-1])
        shared = ends_b[found] == ends_a[:-1]
        at_a, at_b = np.flatnonzero(shared) + 1, found[shared] + 1
        anchor = self.spaced[0][x[at_a]] & self.spaced[1][y[at_b]]
        # The number of the window of every token; a stable sort by it lays windows side by side.
        of = np.zeros(len(x) + len(y), np.int32)
        of[at_a[anchor]] = 1
        of[len(x) + at_b[anchor]] = 1
        of[: len(x)], of[len(x) :] = np.cumsum(of[: len(x)]), np.cumsum(of[len(x) :])
        packed = np.concatenate([x, y | SECOND])[np.argsort(of, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(of))).tolist()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def aligned(self, window: Window) -> tuple[str, bytes]:
        """(groups as text, numbers of the linked pairs as 32-bit integers) of a window."""
        known = self.memo.get(window)
        if known is None:
            ids = struct.unpack(f"={len(window) // 4}I", window)
            first = bisect_left(ids, True, key=SECOND.__le__)
            groups, links = self._align(ids[:first], [i ^ SECOND for i in ids[first:]])
            number = self.pairs.setdefault
            known = groups, struct.pack(f"={len(links)}i", *[number(pair, len(self.pairs)) for pair in links])
            self.memo[window] = known
            self.held += len(ids)
        return known

    def all_aligned(self, cut: list[Window]) -> list[tuple[str, bytes]]:
        found = list(map(self.memo.get, cut))
        return found if all(found) else [self.aligned(window) for window in cut]

    def _align(self, a: tuple[int, ...], b: list[int]) -> tuple[str, list[int]]:
        (size_a, size_b), (name_a, name_b) = self.lengths, self.names
        groups, links, i, j, since_a, since_b = [], [], 0, 0, 0, 0
        last_a, last_b = len(a) - 1, len(b) - 1
        left = size_a[a[0]] - size_b[b[0]]
        while True:
            # Between neighbouring ends of either kind lies one token of each: that is one link.
            links.append((a[i] << 32) | b[j])
            if left < 0:
                i += 1
                left += size_a[a[i]]
            elif left > 0:
                j += 1
                left -= size_b[b[j]]
            else:
                one = name_a[a[i]] if i == since_a else ",".join([name_a[x] for x in a[since_a : i + 1]])
                other = name_b[b[j]] if j == since_b else ",".join([name_b[x] for x in b[since_b : j + 1]])
                groups.append(one + "|" + other)
                if i == last_a and j == last_b:
                    return ";".join(groups), links
                since_a = i = i + 1
                since_b = j = j + 1
                left = size_a[a[i]] - size_b[b[j]]


class Chunk:
    """Documents gathered by a task, with their links as numbers of pairs."""

    def __init__(self, chunk: int) -> None:
        self.chunk, self.tokens = chunk, 0
        self.rows: list[tuple] = []  # key, n_a, n_b, n_groups, n_links, digest, links, times

    def add(self, key, ids, windows: Windows) -> None:
        if ids is None:
            none = np.zeros(0, np.int32)
            self.rows.append((key, 0, 0, 0, 0, "", none, none))
            return
        found = windows.all_aligned(windows.cut(*ids))
        groups = ";".join([f[0] for f in found])
        links = np.frombuffer(b"".join([f[1] for f in found]), np.int32)
        own, times = np.unique(links, return_counts=True)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        self.rows.append((key, len(ids[0]), len(ids[1]), groups.count("|"), len(links), digest, own, times))
        self.tokens += len(ids[0]) + len(ids[1])

    def batches(self, windows: Windows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """First the documents, then the pairs that occur in them, numbered anew, with their occurrences."""
        seen = np.zeros(len(windows.pairs), np.int64)
        for row in self.rows:
            seen[row[6]] += row[7]
        used = np.flatnonzero(seen)
        number = np.zeros(len(seen), np.int32)
        number[used] = np.arange(len(used))
        rows = [(*row[:6], number[row[6]], row[7]) for row in self.rows]
        pairs = np.fromiter(windows.pairs, np.int64, len(seen))
        parts = [
            (len(rows), dict(zip(schema.names[1:9], zip(*rows)))),
            (len(used), {"number": number[used], "pair": pairs[used], "seen": seen[used]}),
        ]
        for size, columns in parts:
            own = {**columns, "chunk": [self.chunk] * size}
            arrays = [pa.array(own[f.name], f.type) if f.name in own else pa.nulls(size, f.type) for f in schema]
            yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=10_000)


FIELDS = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, times array<int>, "
    "number int, pair long, seen long"
)


def chunks(docs: DataFrame, byte_level: str, sentence_pieces: str, key: str, text: str) -> DataFrame:
    """One row per document and one per different pair of a chunk (those have a `pair`)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    first = [T.StructField("chunk", T.LongType()), T.StructField("key", source.schema["key"].dataType)]
    schema = T.StructType([*first, *T._parse_datatype_string(FIELDS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = Windows(byte_level, sentence_pieces), TaskContext.get().partitionId() << 31
        wanted, chunk = to_arrow_schema(schema), Chunk(first)
        for batch in batches:
            keys, texts, begin = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and chars < ENCODED_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                for own, ids in zip(keys[begin:end], windows.encode([t or "" for t in texts[begin:end]])):
                    chunk.add(own, ids, windows)
                    if chunk.tokens >= CHUNK_TOKENS:
                        yield from chunk.batches(windows, wanted)
                        chunk = Chunk(chunk.chunk + 1)
                        if windows.held > MEMO_TOKENS:
                            windows.forget()
                begin = end
        if chunk.rows:
            yield from chunk.batches(windows, wanted)

    return source.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) over all links: `best` where no pair of the same second id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("seen").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row per id of the second vocabulary at most.
    most = F.broadcast(counts.groupBy(second.alias("second")).agg(F.max("count").alias("most")))
    rows = counts.withColumn("second", second).join(most, "second")
    return rows.select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def sums_of_chunk(schema: T.StructType):
    """Adds n_best and count_sum to the documents of one chunk from the figures of its pairs."""

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        best, total = (np.zeros(len(pairs), np.int64) for _ in range(2))
        at = pairs.column("number").to_numpy()
        best[at], total[at] = pairs.column("best").to_numpy(), pairs.column("count").to_numpy()
        n_best, count_sum = [], []
        for own, times in zip(docs.column("links"), docs.column("times")):
            own, times = own.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            n_best.append(int(best[own] @ times))
            count_sum.append(int(total[own] @ times))
        columns = [docs.column("row").combine_chunks(), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
        return pa.Table.from_arrays(columns, names=schema.names)

    return run


def align(docs: DataFrame, byte_level: str, sentence_pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, alignment) per row of `docs`, with a struct of counts and the digest of the groups.

    n_a and n_b tokens of a space and the text by the byte-level and the sentence-piece file; byte
    offsets where tokens of both end cut them into n_groups groups; n_links pairs of overlapping
    tokens; n_best links whose pair is the most frequent one of its second id in the corpus (ties
    too); count_sum, the links' pair counts added; groups_sha256, of `a1,a2|b1;a3|b2,b3`. Texts
    that are null or empty, or that either tokenizer does not give back byte for byte, have
    zeros and no digest. Repeated rows count and stay as often as they are there.
    """
    rows = stored(chunks(docs, byte_level, sentence_pieces, key, text), "aligned")
    of_docs = rows.filter("pair is null")
    # Counting and looking up share one shuffle by pair: a chunk has each pair once.
    pairs = rows.filter("pair is not null").select("chunk", "number", "pair", "seen").repartition("pair")
    figures = pairs.select(F.col("chunk").alias("of"), "number", "pair").join(pair_counts(pairs), "pair").drop("pair")
    shown = ["n_a", "n_b", "n_groups", "n_links"]
    row = F.struct("key", *shown, "groups_sha256").alias("row")
    left = of_docs.select("chunk", row, "links", "times")
    schema = T.StructType([left.schema["row"], *T._parse_datatype_string("n_best long, count_sum long").fields])
    done = left.groupBy("chunk").cogroup(figures.groupBy("of")).applyInArrow(sums_of_chunk(schema), schema)
    columns = [*[F.col(f"row.{c}") for c in shown], "n_best", "count_sum", "row.groups_sha256"]
    return done.select(F.col("row.key").alias(key), F.struct(*columns).alias("alignment"))


def aligned_groups(docs: DataFrame, byte_level: str, sentence_pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups) per row of `docs`: each group as (a, b), the ids of both kinds. No shuffle.

    Documents without tokens, as in `align`, have an empty list.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(byte_level, sentence_pieces)
        for part in texts:
            found = []
            for ids in windows.encode([t or "" for t in part.to_pylist()]):
                found.append(";".join([f[0] for f in windows.all_aligned(windows.cut(*ids))]) if ids else "")
                if windows.held > MEMO_TOKENS:
                    windows.forget()
            yield pa.array(found, pa.string())

    lines = F.arrow_udf(run, "string")("text")
    pair = lambda g: F.struct(*[F.split(F.split_part(g, F.lit("|"), F.lit(k)), ",").cast("array<int>").alias(n) for k, n in ((1, "a"), (2, "b"))])
    listed = F.transform(F.filter(F.split("lines", ";"), lambda g: g != ""), pair)
    return source.select("key", lines.alias("lines")).select(F.col("key").alias(key), listed.alias("groups"))
