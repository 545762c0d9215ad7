"""Start/end pairing over a stream: the operations in flight, in states shared by keys of one hash.

Starts and ends arrive out of order within the watermark delay. They wait in the state of their key (a thread, a
request, a lock attempt) until the watermark has passed their bucket, are then read in time order, and give slices: how
much of a bucket an operation filled, and whether it ended there. An operation that is still open when a bucket closes
fills it, uncounted, and a timer wakes its state at the end of the next one, so open time is reported
second by second without an event. A slice is never taken back, and all slices of a bucket come out of the micro-batch
that closes it; adding them up within that batch therefore gives the final statistics of the bucket.

As in the batch pairing, an end belongs to the event right before it if that is a start, a newer start replaces an
unfinished one (what the old one has already reported stays), and an end without a start is ignored. A key holds what
is buffered and at most one open operation; both are gone when the operation has ended. Keys of one hash are a shard with
one state, paired by whole columns, since a state per operation costs more than all it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from slowtrace.functions.scalars import histogram_columns, log10_bucket
from slowtrace.operators.accounting import slice_stats
from slowtrace.session import folder_exists
from slowtrace.streaming.shards import (
    CHUNK, TIME, as_text, from_text, held, in_pieces, next_moves, pack, spread, unpack,
)

_EVENTS = pa.schema([
    ("key", pa.string()), ("ts", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("payload", pa.string()),
])
_OPEN = pa.schema([("key", pa.string()), ("start", pa.int64()), ("told", pa.int64()), ("payload", pa.string())])
SLICES = StructType([
    StructField("bucket", LongType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("slice", LongType()), StructField("payload", StringType()),
])
_START, _END, _QUIT = 0, 1, 2
_NONE = np.zeros(0, np.int64)


class CallMachine(StatefulProcessor):
    """One shard of keys. Times are microseconds; timers are milliseconds of event time."""

    def __init__(self, bucket: int, start_kind: str, end_kind: str, open_slices: bool, quit_kind: str | None = None):
        self._bucket, self._open_slices = bucket, open_slices
        self._kinds = {start_kind: _START, end_kind: _END, **({} if quit_kind is None else {quit_kind: _QUIT})}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffer = handle.getListState("buffer", CHUNK)
        self._open = handle.getValueState("open", CHUNK)
        self._closed = handle.getValueState("closed", TIME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = [batch[_EVENTS.names] for batch in rows]
        if batches:
            events = pd.concat(batches)
            self._buffer.appendValue(pack(events, _EVENTS))
            self._wake(int(events["ts"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // self._bucket * self._bucket
        if self._closed.exists() and self._closed.get()[0] >= closed:
            return  # another timer of this batch has been here
        waiting = unpack(held(self._buffer), _EVENTS)
        now = unpack([self._open.get()] if self._open.exists() else [], _OPEN)
        due = waiting["ts"] < closed
        rest = waiting[~due]
        ended, passed, still = self._pair(now, waiting[due], closed)
        if due.any():
            self._buffer.clear()
            if len(rest):
                self._buffer.put([pack(rest, _EVENTS)])
        if len(still):
            self._open.update(pack(still, _OPEN))
        elif len(now):
            self._open.clear()
        self._closed.update((closed,))
        if len(still) and self._open_slices:
            self._wake(closed)
        elif len(rest):
            self._wake(int(rest["ts"].min()))
        yield from in_pieces(ended)
        yield from in_pieces(passed)

    def _wake(self, ts: int) -> None:
        self._handle.registerTimer((ts // self._bucket + 1) * self._bucket // 1000)

    def _pair(self, now: pd.DataFrame, due: pd.DataFrame, closed: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
        """Slices of the calls that ended, added up slices of the buckets calls passed through, and what is open at ``closed``."""
        due = due.sort_values(["ts", "seq", "kind", "payload"], kind="stable")
        code = pd.factorize(pd.concat([now["key"], due["key"]]), use_na_sentinel=False)[0]
        # calls carried on come before all events
        order = np.argsort(code, kind="stable")
        code = code[order]
        kind = np.concatenate([np.full(len(now), _START), due["kind"].map(self._kinds).to_numpy(np.int64)])[order]
        ts = np.concatenate([now["start"].to_numpy(np.int64), due["ts"].to_numpy(np.int64)])[order]
        told = np.concatenate([now["told"].to_numpy(np.int64), due["ts"].to_numpy(np.int64)])[order]
        payload = np.concatenate([now["payload"].to_numpy(object), due["payload"].to_numpy(object)])[order]
        name = np.concatenate([now["key"].to_numpy(object), due["key"].to_numpy(object)])[order]
        kind_after, ts_after = next_moves(code, order, ts, kind, _NONE, _NONE, _QUIT)

        start = kind == _START
        done = start & (kind_after == _END)
        open_ = start & (kind_after == -1)
        floor = ts_after // self._bucket * self._bucket
        ended = pd.DataFrame({
            "bucket": floor[done], "start": ts[done], "end": ts_after[done],
            "slice": (ts_after - np.maximum(told, floor))[done], "payload": payload[done],
        })
        if not self._open_slices:
            told_now = told
            passed = ended.iloc[:0]
        else:
            # replaced: nothing more is known of it than that it never ended
            until = np.select([open_, kind_after == _QUIT], [np.full(len(ts), closed), ts_after], floor)
            which, texts = pd.factorize(payload[start])
            which, bucket, time = spread(which, told[start], until[start], self._bucket)
            never = pd.array(np.zeros(len(time), np.int64), dtype="Int64")
            never[:] = pd.NA
            passed = pd.DataFrame({
                "bucket": bucket, "start": never, "end": never, "slice": time, "payload": texts[which]})
            told_now = np.full(len(ts), closed)
        still = pd.DataFrame({
            "key": name[open_], "start": ts[open_], "told": np.maximum(told, told_now)[open_], "payload": payload[open_]})
        return ended, passed, still

    def close(self) -> None:
        pass


def streaming_slices(
    events: DataFrame,
    keys: Sequence[str],
    start_kind: str,
    end_kind: str,
    bucket_us: int,
    payload: Sequence[str] = (),
    delay: str = "2 seconds",
    event_time: str = "event_time",
    open_slices: bool = True,
    quit_kind: str | None = None,
    shards: int = 256,
) -> DataFrame:
    """Slices of operations in closed buckets: bucket, start, end, slice, and the start row's ``payload``.

    ``events(keys…, event_time timestamp, ts long µs, seq, kind, payload…)``. An operation that ended has a row in the
    bucket of its ``end``. Time in other buckets has neither ``start`` nor ``end`` and is added up, over the operations of a
    shard with equal ``payload``; ``open_slices=False`` leaves it out. An event of
    ``quit_kind`` (its thread exits, its set is closed) ends an operation there without an ``end``.

    Threads that wait in a set are operations of the key (set, thread): a busy set is spread over the shards, and
    :func:`wait_batches` adds them up. One task holds what a shard gets in a micro-batch: with more keys take more ``shards``.
    """
    fields = StructType([StructField(c, events.schema[c].dataType) for c in payload])
    rows = events.filter(F.col("kind").isin(*filter(None, [start_kind, end_kind, quit_kind]))).select(
        F.pmod(F.xxhash64(*keys), F.lit(shards)).alias("shard"), as_text(keys).alias("key"), event_time, "ts", "seq", "kind",
        F.when(F.col("kind") == start_kind, as_text(payload)).otherwise("").alias("payload"))
    slices = (
        rows.withWatermark(event_time, delay).groupBy("shard")
        .transformWithStateInPandas(CallMachine(bucket_us, start_kind, end_kind, open_slices, quit_kind), SLICES, outputMode="Append",
                                    timeMode="EventTime")
    )
    if not payload:
        return slices.drop("payload")
    return slices.withColumn("payload", from_text("payload", fields)).select(
        "bucket", "start", "end", "slice", *[F.col(f"payload.{c}").alias(c) for c in payload])


def call_batches(path: str, keys: Sequence[str], ns_per_unit: int = 1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over :func:`streaming_slices`: call statistics of the buckets each batch closes.

    A batch that is run again replaces its own folder.
    """
    def write(slices: DataFrame, batch_id: int) -> None:
        counted = slices.withColumn("counted", F.col("end").isNotNull()).filter("slice > 0 OR counted")
        slice_stats(counted, keys, ns_per_unit).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def wait_batches(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """The same for waits of threads: time, and 0 requests where none ended."""
    def write(slices: DataFrame, batch_id: int) -> None:
        told = slices.filter("slice > 0 OR end IS NOT NULL").groupBy("bucket", *keys).agg(
            F.sum("slice").alias("total_time"), F.count("end").alias("total_requests"))
        told.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def io_batches(path: str, keys: Sequence[str], size: str | None = None, ns_per_unit: int = 1) -> Callable[[DataFrame, int], None]:
    """The same for block IO: the whole latency counts in the bucket of completion."""
    def write(slices: DataFrame, batch_id: int) -> None:
        latency = (F.col("end") - F.col("start")) * F.lit(ns_per_unit).cast("bigint")
        sectors = [] if size is None else [F.sum(size).alias("sector_cnt")]
        (
            slices.filter("end IS NOT NULL").withColumn("__latency", latency)
            .withColumn("__class", log10_bucket(F.col("__latency"))).groupBy("bucket", *keys)
            .agg(F.sum("__latency").alias("total_time"), *sectors, F.count(F.lit(1)).alias("total_requests"),
                 *histogram_columns("__class"))
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        )

    return write


def closed_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All statistics written so far, each bucket and key once."""
    if not folder_exists(spark, path):
        raise FileNotFoundError(f"no batch has been written below {path}")
    return spark.read.parquet(path).drop("batch")
