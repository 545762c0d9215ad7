"""How the given tables stand in for event logs, intervals, series and targets.

Times are integer microseconds; money is integer cents, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.timebase import epoch_us, floor_to

HOUR = 3_600_000_000
DAY = 24 * HOUR
SIX_HOURS_S = 6 * 3600
WEEK = 7 * DAY

EV = """ev AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events)"""

#: Events as intervals that last ``value`` minutes.
REQ = EV + """, req AS (
  SELECT *, t AS s, t + cents * 600000 AS e FROM ev)"""

#: A cumulative counter per user on six-hour epochs.
COUNTER = EV + """, buckets AS (
  SELECT user_id, t // 21600000000 * 21600 AS epoch_s, max(t) // 1000 AS epoch_ms,
         CAST(sum(cents) AS BIGINT) AS cents
  FROM ev GROUP BY ALL), counter AS (
  SELECT user_id, epoch_s, epoch_ms,
         CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY epoch_s) AS DOUBLE) * 1000000 AS value
  FROM buckets)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id", "ts", epoch_us(F.col("ts")).alias("t"), "user_id", "event_type", "value",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumns(
        {"start": F.col("t"), "end": F.col("t") + F.col("cents") * F.lit(600_000).cast("bigint")}
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).select("start", "end", F.col("cents").alias("duration"))


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, epoch_s, epoch_ms, value`` with a value that only grows."""
    from slowtrace.operators.carry import with_running_sum
    from slowtrace.operators.ranges import time_cell

    buckets = (
        events(spark, sf_dir)
        .groupBy("user_id", (floor_to(F.col("t"), 6 * HOUR) / F.lit(1_000_000)).cast("bigint").alias("epoch_s"))
        .agg(F.call_function("div", F.max("t"), F.lit(1000)).alias("epoch_ms"), F.sum("cents").alias("cents"))
    )
    grown = with_running_sum(
        buckets, ["user_id"], ["epoch_s"], {"total": "cents"}, time_cell(F.col("epoch_s"), 7 * 86400)
    )
    return grown.select(
        "user_id", "epoch_s", "epoch_ms", (F.col("total").cast("double") * F.lit(1_000_000)).alias("value")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_type, epoch_s, value``: cents per user, type and day."""
    return per_epoch(spark, sf_dir, DAY, "user_id", "event_type")


def per_epoch(spark: SparkSession, sf_dir: str, width: int, *keys: str) -> DataFrame:
    epoch = F.call_function("div", floor_to(F.col("t"), width), F.lit(1_000_000).cast("bigint"))
    return (
        events(spark, sf_dir)
        .groupBy(*keys, epoch.alias("epoch_s"))
        .agg(F.sum("cents").cast("double").alias("value"))
    )


def orminus(name: str):
    """NULL shown as −1, so that a missing number compares the same everywhere."""
    return F.coalesce(F.col(name), F.lit(-1)).alias(name)
