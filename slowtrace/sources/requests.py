"""Request logs and application series (targets, load)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slowtrace.functions.scalars import us_to_ms
from slowtrace.functions.timebase import floor_div
from slowtrace.schemas import REQUESTS


def read_requests(spark: SparkSession, path: str, fmt: str = "triple") -> DataFrame:
    """``triple``: headerless ``start,end,delay``; ``duration``: ``end_ts,duration_ms`` with ISO
    time; ``memtier``: ``start_epoch_us,end_epoch_us,response_time_us`` with a header."""
    if fmt == "triple":
        return spark.read.schema(REQUESTS).csv(path)
    if fmt == "memtier":
        named = spark.read.option("header", "true").csv(path)
        return named.select(
            F.col("start_epoch_us").cast("bigint").alias("start"),
            F.col("end_epoch_us").cast("bigint").alias("end"),
            F.col("response_time_us").cast("bigint").alias("duration"),
        )
    if fmt == "duration":
        raw = spark.read.option("header", "true").schema("end_ts string, duration_ms double").csv(path)
        utc = F.to_utc_timestamp(F.col("end_ts").cast("timestamp"), F.current_timezone())
        return raw.select(utc.cast("timestamp_ntz").alias("end_ts"), "duration_ms")
    raise ValueError(f"unknown request log format: {fmt}")


def _renamed(raw: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return raw.select(*[col.alias(name) for name, col in columns.items()])


def read_target(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Application series by kind; always starts with ``epoch_s``.

    ``percentile``: ``value`` from a delay or response-time column, as it is;
    ``cumulative``: ``total_events`` and ``experiment_count``;
    ``users``: ``user_count`` by second; ``test_plan``: the same by millisecond;
    ``samples``: ``throughput`` and ``p95_ms`` at seconds relative to the start.
    """
    raw = spark.read.option("header", "true").csv(path)
    return shape_target(raw, kind)


def shape_target(raw: DataFrame, kind: str) -> DataFrame:
    second = F.col("epoch_s").cast("double").cast("bigint") if "epoch_s" in raw.columns else None
    from_ms = floor_div(F.col("epoch_ms").cast("bigint"), 1000) if "epoch_ms" in raw.columns else None
    if kind == "percentile":
        known = ("delay_ms", "delay_us", "response_time_us", "percentile_value")
        value = next(c for c in known if c in raw.columns)
        return _renamed(raw, {"epoch_s": second, "value": F.col(value).cast("double")})
    if kind == "cumulative":
        return _renamed(raw, {
            "epoch_s": from_ms,
            "total_events": F.col("total_events").cast("bigint"),
            "experiment_count": F.col("experiment_count").cast("bigint"),
        })
    if kind in ("users", "test_plan"):
        users = "user_count" if "user_count" in raw.columns else "users_count"
        epoch = second if kind == "users" else from_ms
        return _renamed(raw, {"epoch_s": epoch, "user_count": F.col(users).cast("bigint")})
    if kind == "samples":
        return _renamed(raw, {
            "epoch_s": F.col("Time (seconds)").cast("bigint"),
            "throughput": F.col("Throughput (requests/second)").cast("double"),
            "p95_ms": us_to_ms(F.col("95th Percentile Latency (microseconds)").cast("double")),
        })
    raise ValueError(f"unknown target kind: {kind}")
