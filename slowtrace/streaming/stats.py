"""Bucket statistics over streams: only closed buckets, late rows dropped by the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from slowtrace.functions.scalars import histogram_columns, log10_bucket


def streaming_io_stats(
    completed: DataFrame,
    keys: Sequence[str],
    bucket: str = "1 second",
    delay: str = "9 seconds",
    ts: str = "ts",
    latency_ns: str = "latency_ns",
    size: str | None = None,
) -> DataFrame:
    """Tumbling statistics of completed operations by completion time.

    A bucket appears once the watermark (latest event minus ``delay``) has passed it, and
    never again; rows that come later are dropped. State is one row per open (bucket,
    key), so it is bounded by the delay, not by the stream. ``ts`` is a TIMESTAMP, as
    watermarks need; ``bucket`` is in epoch microseconds.
    """
    sectors = [] if size is None else [F.sum(size).alias("sector_cnt")]
    stats = (
        completed.withColumn("__class", log10_bucket(F.col(latency_ns)))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, bucket).alias("window"), *keys)
        .agg(
            F.sum(latency_ns).alias("total_time"),
            *sectors,
            F.count(F.lit(1)).alias("total_requests"),
            *histogram_columns("__class"),
        )
    )
    start = F.col("window.start")
    rest = [c for c in stats.columns if c not in ("window", *keys)]
    return stats.select(F.unix_micros(start).alias("bucket"), *keys, *rest)


def streaming_wake_stats(
    wakes: DataFrame,
    keys: Sequence[str],
    bucket: str = "1 second",
    delay: str = "2 seconds",
    ts: str = "ts",
    ret: str = "ret",
) -> DataFrame:
    """Wake calls per closed bucket, and how many woke someone."""
    stats = (
        wakes.withWatermark(ts, delay)
        .groupBy(F.window(ts, bucket).alias("window"), *keys)
        .agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col(ret) > 0).alias("successful_count"))
    )
    return stats.select(
        F.unix_micros(F.col("window.start")).alias("bucket"), *keys, "total_requests", "successful_count"
    )
