"""Bucket sums over a stream that keep account of the rows they can no longer take.

Streaming aggregation drops a row behind the watermark and tells only how many there were. Here such a row comes out
with its bucket, its payload and its own values, so that what is reported and what came too late add up to the input.

Keys of one hash are a shard with one state for all their open buckets. A busy key is spread over ``salts`` shards, so
that it is no single task. A bucket comes out once when the watermark passes its end, from all shards in the same
micro-batch; that batch adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from slowtrace.functions.timebase import floor_to
from slowtrace.streaming.shards import CHUNK, TIME, as_text, from_text, held, in_pieces, pack, unpack


class BucketSums(StatefulProcessor):
    """One shard of keys. ``bucket`` is the length of a bucket in microseconds."""

    def __init__(self, bucket: int, values: Sequence[str]):
        self._bucket, self._values = bucket, list(values)
        self._schema = pa.schema([("bucket", pa.int64()), ("key", pa.string()), *[(v, pa.int64()) for v in self._values]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._sums = handle.getListState("sums", CHUNK)
        self._closed = handle.getValueState("closed", TIME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, sums = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            late = self._end(batch["bucket"]) <= now
            yield from in_pieces(batch[late].assign(late=True)[["bucket", "key", "late", "payload", *self._values]])
            sums.append(self._summed(batch[~late]))
        kept = self._summed(pd.concat(sums))
        if len(kept):
            self._sums.appendValue(pack(kept, self._schema))
            self._handle.registerTimer(int(self._end(kept["bucket"].min())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self._closed.exists() and self._closed.get()[0] >= now:
            return  # another timer of this batch has been here
        sums = self._summed(unpack(held(self._sums), self._schema))
        due = self._end(sums["bucket"]) <= now
        rest = sums[~due]
        self._sums.clear()
        if len(rest):
            self._sums.put([pack(rest, self._schema)])
            self._handle.registerTimer(int(self._end(rest["bucket"].min())))
        self._closed.update((now,))
        yield from in_pieces(sums[due].assign(late=False, payload=None)[["bucket", "key", "late", "payload", *self._values]])

    def _end(self, bucket):
        return (bucket + self._bucket) // 1000

    def _summed(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["bucket", "key"], as_index=False, sort=False)[self._values].sum()[self._schema.names]

    def close(self) -> None:
        pass


def sums_and_late_rows(
    rows: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    bucket_us: int,
    delay: str,
    ts: str = "ts",
    payload: Sequence[str] = (),
    salts: int = 8,
    shards: int = 256,
) -> DataFrame:
    """``bucket``, ``keys``, ``late``, ``payload`` and ``values`` (whole numbers, NULL counts as 0).

    A row with ``late`` stands for itself: its payload as JSON and its own values. The others are partial sums of a
    closed bucket. ``ts`` is a TIMESTAMP; a row without one belongs to no bucket and is left out. One task holds the
    open buckets of a shard: with more keys take more ``shards``.
    """
    carried = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}) if payload else F.lit("{}")
    salt = F.pmod(F.xxhash64(ts, carried, *values.values()), F.lit(salts))
    fields = StructType([StructField(k, rows.schema[k].dataType) for k in keys])
    marked = rows.withWatermark(ts, delay).select(
        F.pmod(F.pmod(F.xxhash64(as_text(keys)), F.lit(shards)) + salt, F.lit(shards)).alias("shard"), floor_to(F.unix_micros(ts), bucket_us).alias("bucket"),
        as_text(keys).alias("key"), carried.alias("payload"),
        # the time stamp itself stays behind: grouping by state would drop late rows by it
        *[F.coalesce(v.cast("bigint"), F.lit(0)).alias(n) for n, v in values.items()],
    ).filter("bucket IS NOT NULL")
    schema = StructType([
        StructField("bucket", LongType()), StructField("key", StringType()), StructField("late", BooleanType()),
        StructField("payload", StringType()), *[StructField(v, LongType()) for v in values],
    ])
    return (
        marked.groupBy("shard")
        .transformWithStateInPandas(BucketSums(bucket_us, list(values)), schema, outputMode="Append", timeMode="EventTime")
        .withColumn("key", from_text("key", fields))
        .select("bucket", *[F.col(f"key.{k}").alias(k) for k in keys], "late", "payload", *values)
    )


def late_batches(path: str, keys: Sequence[str], values: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over :func:`sums_and_late_rows`: sums of closed buckets and late rows, apart.

    A batch that is run again replaces its own folders.
    """
    def write(out: DataFrame, batch_id: int) -> None:
        held = out.persist()  # both outputs are read from it, and the state is advanced once
        try:
            (
                held.filter("NOT late").groupBy("bucket", *keys).agg(*[F.sum(v).alias(v) for v in values])
                .write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
            )
            held.filter("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        finally:
            held.unpersist()

    return write


def closed_sums(spark: SparkSession, path: str) -> DataFrame:
    """Each closed bucket and key once."""
    return spark.read.parquet(f"{path}/sums").drop("batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row that came after its bucket had been reported."""
    return spark.read.parquet(f"{path}/late").drop("batch")
