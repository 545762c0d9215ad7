"""Discovery over a stream of accesses: the tracked set grows while events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.operators.discovery import discover
from slowtrace.session import delete_folder


def _version(path: str, batch_id: int) -> tuple[str, str]:
    return f"{path}/tracked/batch={batch_id}", f"{path}/registered/batch={batch_id}"


def start_state(spark: SparkSession, path: str, seeds: DataFrame, resource_type: str = "string") -> None:
    """Version −1 of the state: the seeds, and no resources."""
    tracked, registered = _version(path, -1)
    seeds.select(
        "pid", F.lit(-(1 << 62)).alias("discovered_at"), F.lit(None).cast(resource_type).alias("via"), F.lit(0).alias("hop")
    ).write.mode("overwrite").parquet(tracked)
    spark.createDataFrame([], f"resource {resource_type}, registered_at bigint").write.mode("overwrite").parquet(registered)


def discover_batches(
    path: str, peers: DataFrame | None = None, exits: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: discovery within the batch, starting from the last version.

    Each batch writes its own version of the state from the previous one, so running a
    batch again gives the same version. Batches must come in time order, as file and log
    sources deliver them. ``exits(pid, exited_at)``: an exit takes effect at the end of the
    batch whose time reaches it; until then the process acts. Exits before the process was
    found belong to an earlier process of that number.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before_tracked, before_registered = _version(path, batch_id - 1)
        known = spark.read.parquet(before_tracked)
        resources = spark.read.parquet(before_registered)
        accesses = batch.select("pid", "resource", "ts").persist()
        try:
            found, registered = discover(accesses, known.select("pid", "discovered_at"), peers, registered=resources)
            fresh = found.join(known.select("pid"), ["pid"], "left_anti")
            tracked = known.unionByName(fresh)
            if exits is not None:
                reached = accesses.agg(F.max("ts")).scalar()
                gone = tracked.join(exits.filter(F.col("exited_at") <= reached), ["pid"]).filter(
                    F.col("exited_at") >= F.col("discovered_at")
                )
                tracked = tracked.join(gone.select("pid"), ["pid"], "left_anti")
            now_tracked, now_registered = _version(path, batch_id)
            tracked.write.mode("overwrite").parquet(now_tracked)
            registered.write.mode("overwrite").parquet(now_registered)
            # a batch that runs again needs the version before it, and none older
            for old in _version(path, batch_id - 2):
                delete_folder(spark, old)
        finally:
            accesses.unpersist()

    return advance


def tracked_at(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(_version(path, batch_id)[0])
