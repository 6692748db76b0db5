"""Incremental forms: resume as a file stream, and deltas with kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from turnstate.operators.resume import turns_to_process


def resume_stream(
    spark: SparkSession,
    turns_path: str,
    schema: StructType,
    stored_path: str,
    track: Callable[[DataFrame], DataFrame],
    checkpoint: str,
) -> None:
    """Label turns that arrived since the last call and were not stored with equal texts.

    Each micro-batch joins only its own turns with the stored ones and appends the new
    labels; the checkpoint remembers which files are done.
    """
    stored_schema = "interaction_id string, turn_number int, human_input string, ai_response string, seq bigint"
    start = spark.createDataFrame([], stored_schema)
    start.write.mode("ignore").parquet(f"{stored_path}/batch=-1")

    def process(batch: DataFrame, batch_id: int) -> None:
        stored = spark.read.schema(f"{stored_schema}, batch bigint").parquet(stored_path)
        # A batch that runs again after a lost driver must not see its own earlier rows.
        fresh = turns_to_process(batch, stored.filter(F.col("batch") < batch_id))
        (
            track(fresh)
            .withColumn("seq", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .parquet(f"{stored_path}/batch={batch_id}")
        )

    stream = spark.readStream.schema(schema).parquet(turns_path)
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def delta_stream(
    stream: DataFrame, *, key: str, key_type: str, order_by: Sequence[tuple[str, str]], value: str,
    ordered: Sequence[str],
) -> DataFrame:
    """Ordinal steps of a keyed stream; the state of a key is its last order and value.

    Rows of a batch are put in order per key. A row that does not come after the last one
    seen gets `late` and changes nothing.
    """
    names = [n for n, _ in order_by]
    rank = {v: i for i, v in enumerate(ordered)}
    scale = float(len(ordered) - 1)
    order_ddl = ", ".join(f"{n} {t}" for n, t in order_by)
    out_ddl = (
        f"{key} {key_type}, "
        + ", ".join(f"from_{n} {t}" for n, t in order_by) + ", "
        + ", ".join(f"to_{n} {t}" for n, t in order_by)
        + ", delta double, late boolean"
    )

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(names)
        out = []
        for row in rows[[*names, value]].itertuples(index=False):
            at = tuple(row[:-1])
            if last is not None:
                late = at <= tuple(last[:-1])
                a, b = rank.get(last[-1]), rank.get(row[-1])
                step_size = None if late or a is None or b is None else (b - a) / scale
                out.append((group[0], *last[:-1], *at, step_size, late))
                if late:
                    continue
            last = (*at, row[-1])
        state.update(last)
        columns = [key, *[f"from_{n}" for n in names], *[f"to_{n}" for n in names], "delta", "late"]
        yield pd.DataFrame(out, columns=columns)

    return (
        stream.select(key, *names, value)
        .groupBy(key)
        .applyInPandasWithState(
            step, out_ddl, f"{order_ddl}, {value} string", "append", GroupStateTimeout.NoTimeout
        )
    )
