"""Per-bucket statistics of finished (and still open) operations, and the merge of late slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.scalars import histogram_columns, log10_bucket
from slowtrace.functions.timebase import NS_PER_S, floor_to
from slowtrace.operators.intervals import split_by_bucket, upright
from slowtrace.operators.keys import join_groups


def io_stats(
    paired: DataFrame,
    keys: Sequence[str],
    bucket: int = NS_PER_S,
    size: str | None = "size",
    ns_per_unit: int = 1,
) -> DataFrame:
    """Block IO: everything, the whole latency included, lands in the bucket of completion."""
    latency = (F.col("end") - F.col("start")) * F.lit(ns_per_unit).cast("bigint")
    sectors = [] if size is None else [F.sum(size).alias("sector_cnt")]
    return (
        paired.withColumns({"bucket": floor_to(F.col("end"), bucket), "__latency": latency})
        .withColumn("__class", log10_bucket(F.col("__latency")))
        .groupBy("bucket", *keys)
        .agg(
            F.sum("__latency").alias("total_time"),
            *sectors,
            F.count(F.lit(1)).alias("total_requests"),
            *histogram_columns("__class"),
        )
    )


def _call_slices(calls: DataFrame, bucket: int, horizon: int | Column | None) -> DataFrame:
    """Slices of calls per bucket; ``counted`` marks the one that holds the completion."""
    done = F.col("end").isNotNull()
    calls = upright(calls)
    if horizon is None:
        bounded, stop = calls.filter(done), "end"
    else:
        limit = horizon if isinstance(horizon, Column) else F.lit(horizon).cast("bigint")
        bounded, stop = calls.withColumn("__stop", F.coalesce(F.col("end"), limit)), "__stop"
    # an open call may start after the horizon
    sliced = split_by_bucket(bounded, bucket, "start", stop, touch_end=True, clipped=True)
    counted = done & (F.col("bucket") == floor_to(F.col("end"), bucket))
    return sliced.withColumn("counted", counted).filter("slice > 0 OR counted")


def call_stats(
    paired: DataFrame,
    keys: Sequence[str],
    bucket: int = NS_PER_S,
    horizon: int | Column | None = None,
    ns_per_unit: int = 1,
) -> DataFrame:
    """File, socket and lock calls: time is split by bucket, the request counts at completion.

    Buckets that a call only passes through have time but NULL counts. With a
    ``horizon``, calls without an end are accounted up to it, without being counted.
    One explode and one shuffle: the completion is the slice whose bucket holds the end.
    """
    return slice_stats(_call_slices(paired, bucket, horizon), keys, ns_per_unit)


def slice_stats(slices: DataFrame, keys: Sequence[str], ns_per_unit: int = 1) -> DataFrame:
    """Statistics per bucket of the slices (bucket, start, end, slice, counted) of calls."""
    scale = F.lit(ns_per_unit).cast("bigint")
    latency = log10_bucket((F.col("end") - F.col("start")) * scale)
    classed = slices.withColumn("__class", F.when(F.col("counted"), latency))
    return classed.groupBy("bucket", *keys).agg(
        (F.sum("slice") * scale).alias("total_time"),
        F.expr("sum(CASE WHEN counted THEN 1L END) AS total_requests"),
        *histogram_columns("__class"),
    )


def call_times(
    paired: DataFrame, keys: Sequence[str], bucket: int = NS_PER_S, horizon: int | Column | None = None
) -> DataFrame:
    """``call_stats`` without the histogram, and with 0 for buckets without a completion."""
    return _call_slices(paired, bucket, horizon).groupBy("bucket", *keys).agg(
        F.sum("slice").alias("total_time"), F.count_if("counted").alias("total_requests")
    )


def wake_stats(
    wakes: DataFrame, keys: Sequence[str], bucket: int = NS_PER_S, ts: str = "ts", ret: str = "ret"
) -> DataFrame:
    """Wake calls per bucket, and how many woke someone."""
    return (
        wakes.withColumn("bucket", floor_to(F.col(ts), bucket))
        .groupBy("bucket", *keys)
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(F.col(ret) > 0).alias("successful_count"),
        )
    )


def pending_slices(
    calls: DataFrame, bucket: int, since: str, until: str, carry: Sequence[str]
) -> DataFrame:
    """Whole-bucket parts of open or boundary-crossing calls: ``additional_time`` per bucket.

    ``since`` is where the previous sample stopped (or the call's start), ``until`` the
    start of the current bucket, which belongs to the completion row.
    """
    bounded = upright(calls, since, until).withColumn("__until", floor_to(F.col(until), bucket))
    return (
        split_by_bucket(bounded, bucket, since, "__until", clipped=True)
        .select("bucket", *carry, F.col("slice").alias("additional_time"))
    )


def merge_pending(target: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add staged time to matching rows and insert the rest with only keys and time.

    ``target`` has one row per key; ``staging`` may have several. Both are stacked and
    summed in one aggregation, which combines on the map side and needs no join. A
    staged-only row keeps NULL requests and histogram because a sum of NULLs is NULL.
    """
    counters = [c for c in target.columns if c not in keys and c != "total_time"]
    added = staging.groupBy(*keys).agg(F.sum("additional_time").alias("total_time"))
    merged = (
        target.unionByName(added, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.sum("total_time").alias("total_time"), *[F.sum(c).alias(c) for c in counters])
    )
    return merged.select(*target.columns)


def new_keys(staging: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged rows whose key the target does not have."""
    return join_groups(staging, target.select(*keys), keys, "left_anti")
