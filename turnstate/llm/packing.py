"""Best-fit packing of token pieces into sequences: bounded-space and online.

A task reads its pieces as a stream and keeps a fixed number of open sequences. A bitset has one
bit for each amount of free space that some open sequence has, so the tightest one that still
takes a piece is the lowest set bit from the piece's length on. When a new sequence is needed and
all places are taken, the fullest open one is closed. Pieces are looked at in short runs, largest
first, which is when best fit wastes least.

Sequences still open at the end of a task are not given up: their pieces go on to a task that
takes over from several, round by round until one task is left. What a task takes over is
bounded by the open sequences of its predecessors, not by the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.llm.tables import stored
from turnstate.llm.vocabularies import ByteLevelEncoder

OPEN = 2048  # open sequences of a task
RUN = 2048  # pieces that are put in order before they are placed
TAKES_OVER = 8  # tasks whose open sequences one task of the next round goes on with
END = 0  # the id after every document
PART_TOKENS = 1 << 20  # ids gathered before pieces are passed on


# --- documents to pieces


def piece_cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all of full length but the first."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def pieces(docs: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, tokens): every document's ids, cut to at most `capacity`.

    The ids are those of the tokenizer file, special tokens as plain text, and a closing 0. Only
    a longer document is cut. `tokens` holds a piece's ids as little-endian unsigned 32-bit
    integers. A null text counts as empty, one piece with the closing id alone. Repeated rows
    give repeated pieces; the key may be null or of any type.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", source.schema["key"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(path)
        for batch in batches:
            row, found, gathered = [], [], 0
            keys = batch.column(0)

            def part():
                number, start, length, tokens = zip(*found)
                columns = [keys.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64())]
                return pa.RecordBatch.from_arrays([*columns, pa.array(length, pa.int64()), pa.array(tokens, pa.binary())], schema.names)

            for k in range(len(batch)):
                ids = np.array([*encoder.ids(batch.column(1)[k].as_py() or ""), END], dtype="<u4")
                for number, (start, length) in enumerate(piece_cuts(len(ids), capacity)):
                    row.append(k)
                    found.append((number, start, length, ids[start : start + length].tobytes()))
                gathered += len(ids)
                if gathered >= PART_TOKENS:
                    yield part()
                    row, found, gathered = [], [], 0
            if found:
                yield part()

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


# --- pieces to sequences


class OpenSequences:
    """The open sequences of a task: how much is free in each, and a bit for every amount that occurs."""

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.bits, self.open, self.started = 0, 0, 0
        self.with_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        number = self.with_free[free].pop()
        if not self.with_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """(sequence, offset, sequences closed by it) for a piece that is at most the capacity."""
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.places:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            number, free = self.started, self.capacity
            self.started += 1
        offset, left = self.capacity - free, free - length
        if left:
            self.with_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        else:
            closed.append(number)
        return number, offset, closed


def packed_runs(tables: Iterator[pa.Table], capacity: int, first_id: int, task: int) -> Iterator[pa.Table]:
    """Tables of (row, length) with columns task, open, sequence_id and offset: closed ones as they close.

    Rows without a length pass through at once, with no place.
    """
    state = OpenSequences(capacity, OPEN)
    held = None  # rows of open sequences: (table, sequence, offset)
    schema_end = [("task", pa.int64()), ("open", pa.bool_()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def out(table: pa.Table, number, offset, still_open: bool) -> pa.Table:
        same = [np.full(len(number), task), np.full(len(number), still_open), number, offset]
        for (name, kind), values in zip(schema_end, same):
            table = table.append_column(name, pa.array(values, kind))
        return table

    for table in tables:
        sized = pc.greater(pc.fill_null(table.column("length"), 0), 0)
        if (unplaced := table.filter(pc.invert(sized))).num_rows:
            none = pa.nulls(len(unplaced), pa.int64())
            yield out(unplaced, none, none, False)
        table = table.filter(sized)
        for begin in range(0, len(table), RUN):
            run = table.slice(begin, RUN)
            lengths = run.column("length").to_numpy()
            if len(lengths) and lengths.max() > capacity:
                raise ValueError(f"a piece of {lengths.max()} tokens is over the capacity of {capacity}")
            number, offset, closed = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64), []
            for k in np.argsort(-lengths, kind="stable").tolist():
                number[k], offset[k], ended = state.place(int(lengths[k]))
                closed += ended
            if held is not None:
                run = pa.concat_tables([held[0], run])
                number, offset = np.concatenate([held[1], number]), np.concatenate([held[2], offset])
            ended = np.isin(number, closed)
            order = np.flatnonzero(ended)
            order = order[np.lexsort((offset[order], number[order]))]
            yield out(run.take(order), number[order] + first_id, offset[order], False)
            rest = np.flatnonzero(~ended)
            held = (run.take(rest), number[rest], offset[rest])
    if held is not None:
        yield out(held[0], held[1] + first_id, held[2], True)


def _sequence_base(round_: int, task: int) -> int:
    """Numbers of a task's sequences begin here: 2^30 for each of 2^27 tasks of each of 32 rounds."""
    return (round_ << 57) | (task << 30)


def taking_over(capacity: int, round_: int):
    """Packs what several tasks have left open; a group holds the pieces of that many tasks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        task = group.column("task")[0].as_py() // TAKES_OVER
        tables = packed_runs(iter([group.select(["row", "length"])]), capacity, _sequence_base(round_, task), task)
        return pa.concat_tables(list(tables))

    return run


def pack(rows: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """The rows of `rows` with their place: `sequence_id` and `offset`, gapless from 0.

    Every row is a piece of `length` tokens; one over the capacity is an error. A piece of null
    or no length needs no place and gets null ones. Ties and repeated rows are placed one by one,
    in any order. Existing columns `sequence_id` and `offset` are replaced.
    """
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    kept = [F.col(f"`{c}`") for c in names]
    source = rows.select(F.struct(*kept).alias("row"), F.col(f"`{length}`").cast("long").alias("length"))
    added = "task long, open boolean, sequence_id long, offset long"
    schema = T.StructType([*source.schema.fields, *T._parse_datatype_string(added).fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tables = (pa.Table.from_batches([b]) for b in batches)
        for table in packed_runs(tables, capacity, _sequence_base(0, task), task):
            yield from table.to_batches()

    placed = stored(source.mapInArrow(stream, schema), "packed")
    found, round_ = [placed.filter("not open")], 0
    while (last := placed.filter("open").agg(F.max("task")).first()[0] or 0) > 0:
        round_ += 1
        over = placed.filter("open").groupBy(F.expr(f"task div {TAKES_OVER}").alias("taker"))
        placed = stored(over.applyInArrow(taking_over(capacity, round_), schema), "packed")
        found.append(placed.filter("not open"))
    found.append(placed.filter("open"))
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, pieces, tokens): the packed ids themselves, one row per sequence.

    `pieces` are the lengths of the pieces in order, `tokens` their ids one after the other as
    in `pieces()`. A group is a sequence, so it is bounded by the capacity.
    """
    entry = F.struct("offset", F.col("length").cast("long").alias("length"), "tokens")
    gathered = packed.filter("sequence_id is not null").groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    joined = F.aggregate("m.tokens", F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part))
    total = F.aggregate("m.length", F.lit(0).cast("long"), lambda a, b: a + b)
    return gathered.select("sequence_id", total.alias("length"), F.col("m.length").alias("pieces"), joined.alias("tokens"))
