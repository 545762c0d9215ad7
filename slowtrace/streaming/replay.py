"""Poll/epoll waits in micro-batches of closed buckets, without per-set state in one task.

The state machine in ``waits`` keeps all events of a set in one task. When one set makes
up a large part of the stream, use this instead: each micro-batch replays the buckets
that have closed since the last one with the batch operators, which split a busy set
over time cells. What stays open is carried to the next batch as a few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.timebase import NS_PER_S
from slowtrace.operators.multiplex import muxio_file_wait, muxio_wait, open_state, settled_history
from slowtrace.session import delete_folder, settled_tables

THREADS, FILES = "thread_waits", "file_waits"


_CLOCK = "closed bigint, newest bigint, results string"


def _folder(path: str, what: str, batch_id: int) -> str:
    return f"{path}/{what}/batch={batch_id}"


def replay_batches(
    path: str, bucket: int = NS_PER_S, delay: int = 2 * NS_PER_S, cell_width: int | None = 3600 * NS_PER_S,
    results: Sequence[str] = (THREADS, FILES),
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over raw poll/epoll events.

    A bucket closes once an event later than its end by ``delay`` has been seen; rows for
    a closed bucket that come later are dropped. Every batch reads the last version of
    the state and writes its own, so a batch that is run again has the same result.
    Of ``results`` only those named are made, and only what they need is carried; they stay the same over a stream's life.
    """
    asked = ",".join(r for r in (THREADS, FILES) if r in results)

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        now, last = (lambda what: _folder(path, what, batch_id)), (lambda what: _folder(path, what, batch_id - 1))
        closed_before, newest, carried = None, None, None
        if batch_id > 0:
            clock = spark.read.schema(_CLOCK).parquet(last("clock")).first()
            if (clock.results or f"{THREADS},{FILES}") != asked:
                raise ValueError(f"the state below {path} was carried for {clock.results}, not for {asked}")
            closed_before, newest = clock.closed, clock.newest
            carried = spark.read.schema(schema).parquet(last("state"))
        arrived = batch if carried is None else batch.unionByName(spark.read.schema(schema).parquet(last("pending")))
        if closed_before is not None:
            arrived = arrived.filter(F.col("ts") >= closed_before)
        arrived.write.mode("overwrite").parquet(now("arrived"))
        events = spark.read.schema(schema).parquet(now("arrived"))
        first, latest = events.agg(F.min("ts"), F.max("ts")).first()
        newest = max((t for t in (newest, latest) if t is not None), default=None)
        start = closed_before if closed_before is not None else first
        closed = None if newest is None else (newest - delay) // bucket * bucket
        if start is None or closed is None or closed <= start:
            closed = closed_before
            pending = events
            state = carried if carried is not None else events.filter(F.lit(False))
            state.write.mode("overwrite").parquet(now("state"))
        else:
            due = events.filter(F.col("ts") < closed)
            replayed = due if carried is None else carried.unionByName(due)
            pending = events.filter(F.col("ts") >= closed)
            with settled_tables(spark):
                history = settled_history(replayed, cell_width) if FILES in results else None
                if THREADS in results:
                    muxio_wait(replayed, bucket, closed, cell_width).write.mode("overwrite").parquet(now(THREADS))
                if FILES in results:
                    files = muxio_file_wait(replayed, bucket, closed, cell_width, history=history)
                    files.write.mode("overwrite").parquet(now(FILES))
                state = open_state(replayed, closed, cell_width, history=history, with_files=FILES in results)
                state.select(*schema.names).write.mode("overwrite").parquet(now("state"))
        pending.write.mode("overwrite").parquet(now("pending"))
        spark.createDataFrame([(closed, newest, asked)], _CLOCK).write.mode("overwrite").parquet(now("clock"))
        # a batch that runs again needs the version before it, and none older
        for what in ("state", "pending", "clock"):
            delete_folder(spark, _folder(path, what, batch_id - 2))
        delete_folder(spark, now("arrived"))

    return advance


def replayed_waits(spark: SparkSession, path: str, what: str) -> DataFrame:
    """All results so far: ``thread_waits`` or ``file_waits``."""
    return spark.read.parquet(f"{path}/{what}").drop("batch")
