"""Running a stream until its present input is used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from slowtrace.session import scratch_path

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
_TASKS_PER_CORE, _LEAST_TASKS = 2, 16


def state_tasks(spark: SparkSession) -> int:
    """Partitions of keyed state: as many as the cores keep busy, and no more than the session asks for.

    Every partition costs a store and a Python worker in every micro-batch, however little it holds, and adaptive execution
    does not join those of a stream.
    """
    wanted = max(_LEAST_TASKS, _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return min(int(spark.conf.get(_PARTITIONS)), wanted)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as processors with timers need, in :func:`state_tasks` partitions."""
    ours = {_STATE_STORE: _ROCKSDB, _PARTITIONS: str(state_tasks(spark))}
    before = {name: spark.conf.get(name, None) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)  # taken over by the query when it starts
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything the source has now to a folder; the next call goes on from there."""
    with _keyed_state(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def drain_stateful(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """:func:`drain_batches` for a stream with keyed state and timers."""
    with _keyed_state(stream.sparkSession):
        return drain_batches(stream, each, checkpoint)


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Hand every micro-batch the source has now to ``each``; returns the last batch id."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a fresh folder below the shared one, and read it back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    drain_to_parquet(stream, f"{path}/data", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
