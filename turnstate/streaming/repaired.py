"""Streams whose tables are repaired batch by batch: resumed labels, and deltas with late rows.

Both keep their history in buckets by key under a versioned root (`sinks.versions`). A micro-batch
opens the buckets of its own keys, computes with the ordinary DataFrame operators, and commits its
results and its number in one manifest. A batch that runs again after a lost driver finds its
number there and does nothing. Buckets with many segments are merged by the batch that touches them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstate.operators.ordered import adjacent
from turnstate.operators.resume import KEY, turns_to_process
from turnstate.operators.states import delta
from turnstate.sinks.versions import BUCKETS, SEGMENTS, Version, Versions, bucket_of, buckets_in

# Takes the batch, the store, its version, the batch's number, and a function that keeps a frame
# for the length of the batch; gives the parts of the next version and its notes.
Keep = Callable[[DataFrame], DataFrame]
Process = Callable[[DataFrame, Versions, Version, int, Keep], tuple[list, dict]]


def run_batches(stream: DataFrame, root: str, checkpoint: str, process: Process) -> None:
    """Run what has arrived through `process`, each batch committed once."""
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        store = Versions(spark, root)
        at = store.current()
        if int(at.notes.get("batch", -1)) >= batch_id:
            return
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            parts, notes = process(keep(batch), store, at, batch_id, keep)
            store.commit(at, parts, batch=batch_id, **notes)
        finally:
            for df in kept:
                df.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# --- resumed labels


def resume_labels(
    stream: DataFrame, root: str, track: Callable[[DataFrame], DataFrame], labels: StructType, checkpoint: str, *,
    buckets: int = BUCKETS, segments: int = SEGMENTS,
) -> None:
    """Label the turns of a stream that have no stored label with equal texts.

    `labels` is the schema that `track` gives: the key, both texts and what is stored with them.
    Stored rows have `seq`, the batch that labelled them.
    """
    schema = StructType([*labels.fields]).add("seq", "long")
    bucket = bucket_of("interaction_id", buckets=buckets)

    def process(batch, store, at, batch_id, keep):
        own = buckets_in(batch, bucket)
        history = store.read("labels", schema, at=at, buckets=own)
        fresh = track(turns_to_process(batch, history)).select(*labels.names).withColumn("seq", F.lit(batch_id).cast("bigint"))
        full = at.crowded("labels", own, segments)
        rows = fresh
        if full:
            rows = latest_labels(fresh.unionByName(history.filter(bucket.isin(full))))
        return [*at.without("labels", full), *store.add(rows, "labels", bucket)], {}

    run_batches(stream, root, checkpoint, process)


def latest_labels(rows: DataFrame) -> DataFrame:
    """The last label of every turn."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*KEY, "_last.*")


def stored_labels(spark: SparkSession, root: str, labels: StructType) -> DataFrame:
    """The current label of every turn, with the batch that gave it."""
    schema = StructType([*labels.fields]).add("seq", "long")
    return latest_labels(Versions(spark, root).read("labels", schema))


# --- deltas


def steps_schema(rows: StructType, key: str, order_by: Sequence[str]) -> StructType:
    out = StructType([rows[key]])
    for side in ("from", "to"):
        for name in order_by:
            out = out.add(f"{side}_{name}", rows[name].dataType)
    return out.add("delta", "double").add("seq", "long")


def repaired_steps(
    stream: DataFrame, root: str, checkpoint: str, *, key: str, order_by: Sequence[str], value: str, ordered: Sequence[str],
    lateness: str | None = None, buckets: int = BUCKETS, segments: int = SEGMENTS,
) -> None:
    """Ordinal steps between neighbouring rows of a key, whatever order they arrive in.

    A row that arrives between two known ones adds the step that leads to it and replaces the one
    that leads to its successor, so the stored steps are always those of all rows seen so far. With
    `lateness`, an interval of the first order column, the history a key has to keep is bounded:
    rows up to the newest value seen minus the interval are final, and one that arrives behind
    them is set aside in table `late`. A second row with the key and order of a known one is
    ignored. `current_steps` reads the result.
    """
    row_schema = StructType([stream.schema[c] for c in (key, *order_by, value)])
    step_schema = steps_schema(row_schema, key, order_by)
    bucket, order = bucket_of(key, buckets=buckets), F.struct(*order_by)
    members = [*order_by, value]

    def process(batch, store, at, batch_id, keep):
        rows, notes, parts = batch.select(*row_schema.names), {}, list(at.parts)
        horizon = at.notes.get("horizon")
        if lateness is not None:
            newest = rows.agg((F.max(order_by[0]) - F.expr(f"interval {lateness}")).cast("string")).first()[0]
            notes["horizon"] = max(filter(None, (horizon, newest)), default="")
            if horizon:
                behind = F.col(order_by[0]) <= F.lit(horizon).cast(row_schema[order_by[0]].dataType)
                parts += store.add(rows.filter(behind).withColumn("seq", F.lit(batch_id).cast("bigint")), "late")
                rows = rows.filter(~behind)
        own = buckets_in(rows, bucket)
        history = store.read("rows", row_schema, at=at, buckets=own)
        known = history.select(key, *order_by)
        fresh = rows.dropDuplicates([key, *order_by])
        fresh = keep(fresh.join(known, _same(fresh, known, [key, *order_by]), "left_anti"))
        # Of a key's history only what follows its first new row matters, and the row before that.
        first = fresh.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
        related = history.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        before = related.filter(order < F.col("_first")).groupBy(key).agg(F.max_by(F.struct(*members), order).alias("_row"))
        around = before.select(key, "_row.*").unionByName(related.filter(order > F.col("_first")).drop("_first"))
        both = keep(around.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True))))
        seen = adjacent(both, [key], order_by, previous=[*members, "_new"])
        seen = seen.filter(F.col("previous").isNotNull() & (F.col("_new") | F.col("previous._new")))
        steps = seen.select(
            key,
            *[F.col(f"previous.{c}").alias(f"from_{c}") for c in order_by],
            *[F.col(c).alias(f"to_{c}") for c in order_by],
            delta(F.col(f"previous.{value}"), F.col(value), ordered).alias("delta"),
            F.lit(batch_id).cast("bigint").alias("seq"),
        )
        full = at.crowded("rows", own, segments)
        if full:
            kept = history.filter(bucket.isin(full))
            if horizon:
                kept = retained(kept, key, order_by, value, horizon)
            fresh = fresh.unionByName(kept)
            earlier = store.read("steps", step_schema, at=at, buckets=full)
            steps = latest_steps(steps.unionByName(earlier), key, order_by).select(*step_schema.names)
            parts = [p for p in parts if p.name not in ("rows", "steps") or p.bucket not in full]
        return [*parts, *store.add(fresh, "rows", bucket), *store.add(steps, "steps", bucket)], notes

    run_batches(stream, root, checkpoint, process)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]):
    same = [left[n].eqNullSafe(right[n]) for n in names]
    whole = same[0]
    for one in same[1:]:
        whole = whole & one
    return whole


def retained(rows: DataFrame, key: str, order_by: Sequence[str], value: str, horizon: str) -> DataFrame:
    """Rows that may still get a neighbour: those after the horizon and the last one up to it, per key."""
    final = F.col(order_by[0]) <= F.lit(horizon).cast(rows.schema[order_by[0]].dataType)
    last = F.max_by(F.struct(*order_by, value), F.struct(*order_by)).alias("_row")
    return rows.filter(~final).unionByName(rows.filter(final).groupBy(key).agg(last).select(key, "_row.*"))


def latest_steps(rows: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Of the steps to one row, the one of the last batch."""
    to = [f"to_{c}" for c in order_by]
    rest = [c for c in rows.columns if c not in (key, *to)]
    return rows.groupBy(key, *to).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(key, *to, "_last.*")


def current_steps(spark: SparkSession, root: str, rows: StructType, key: str, order_by: Sequence[str]) -> DataFrame:
    """The steps between all rows seen so far. `rows` is the schema of the stream."""
    schema = steps_schema(rows, key, order_by)
    return latest_steps(Versions(spark, root).read("steps", schema), key, order_by).select(*[c for c in schema.names if c != "seq"])
