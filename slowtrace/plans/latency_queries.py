"""Queries on response-time quantiles, throughput and correlation with a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.scalars import slo_flag
from slowtrace.functions.timebase import floor_div
from slowtrace.operators import correlate as co, latency
from slowtrace.operators.intervals import active_at_ticks
from slowtrace.plans.bindings import DAY, EV, HOUR, REQ, events, intervals, per_epoch, requests
from slowtrace.plans.jobs import request_report
from slowtrace.plans.registry import query
from slowtrace.session import scratch_path, settle

_TICKS = f"""WITH {REQ}, span AS (SELECT min(s) AS lo, max(e) AS hi FROM req
), ticks AS (SELECT lo + unnest(generate_series(0, {{stop}})) * {HOUR} AS tick FROM span
), active AS (SELECT tick, cents, event_id FROM ticks JOIN req ON s <= tick AND e > tick - {HOUR})"""
_WITHIN = _TICKS.format(stop=f"(hi - lo) // {HOUR}")
_BEYOND = _TICKS.format(stop=f"(hi - lo + {HOUR - 1}) // {HOUR}")


@query("a9_response_percentiles", f"""{_BEYOND}
SELECT tick AS epoch_s, coalesce(round(p, 6), -1) AS percentile_value, CASE WHEN p > 15000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slo_violation
FROM ticks LEFT JOIN (SELECT tick, quantile_cont(cents, 0.95) AS p FROM active GROUP BY tick) USING (tick)""")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = latency.response_percentiles(requests(spark, sf_dir), 0.95, HOUR, slo=15000)
    return values.withColumn("percentile_value", F.coalesce(F.round("percentile_value", 6), F.lit(-1.0)))


@query("a9_response_percentiles_inclusive", f"""WITH {REQ}, hours AS (
  SELECT s // {HOUR} AS h0, e // {HOUR} AS h1, cents FROM req
), ticks AS (SELECT unnest(generate_series(min(h0), max(h1))) AS tick FROM hours)
SELECT tick AS epoch_s, coalesce(round(quantile_cont(cents, 0.9), 6), -1) AS percentile_value
FROM ticks LEFT JOIN hours ON h0 <= tick AND h1 >= tick GROUP BY tick""")
def a9_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = requests(spark, sf_dir).withColumns({c: floor_div(F.col(c), HOUR) for c in ("start", "end")})
    values = latency.response_percentiles(hours, 0.9, 1, inclusive_end=True)
    return values.withColumn("percentile_value", F.coalesce(F.round("percentile_value", 6), F.lit(-1.0)))


@query("a10_response_percentiles_hdr", f"""{_WITHIN}, slots AS (
  SELECT tick, cents + (1 << greatest(length(bin(cents)) - 8, 0)) - 1 - cents % (1 << greatest(length(bin(cents)) - 8, 0)) AS slot FROM active
), placed AS (
  SELECT tick, slot, row_number() OVER (PARTITION BY tick ORDER BY slot) AS place, count(*) OVER (PARTITION BY tick) AS n FROM slots)
SELECT ticks.tick // {HOUR} AS tick, coalesce(min(slot), 0) AS value
FROM ticks LEFT JOIN placed ON placed.tick = ticks.tick AND place >= greatest(ceil(0.95::DOUBLE * n), 1) GROUP BY ticks.tick""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.response_percentiles_hdr(requests(spark, sf_dir), 0.95, HOUR)


@query("a10_stored_histograms", f"""WITH {REQ}, slots AS (
  SELECT event_type, e // {HOUR} * {HOUR} AS tick,
         cents + (1 << greatest(length(bin(cents)) - 8, 0)) - 1 - cents % (1 << greatest(length(bin(cents)) - 8, 0)) AS slot FROM req
), placed AS (SELECT *, row_number() OVER (PARTITION BY event_type, tick ORDER BY slot) AS place,
                     count(*) OVER (PARTITION BY event_type, tick) AS n FROM slots)
SELECT event_type, tick, max(n) AS total, min(slot) FILTER (place >= ceil(0.5::DOUBLE * n)) AS p50,
       min(slot) FILTER (place >= ceil(0.99::DOUBLE * n)) AS p99 FROM placed GROUP BY ALL""")
def a10_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles per hour from histograms stored per minute, without the log."""
    log = intervals(spark, sf_dir).select("event_type", "end", F.col("cents").alias("duration"))
    stored = settle(latency.tick_histograms(log, 60_000_000, ["event_type"]))
    hours = latency.merged_histograms(stored, HOUR, ["event_type"])
    return latency.histogram_quantiles(hours, [0.5, 0.99], ["event_type"])


@query("job_request_report", f"""{_WITHIN}, slots AS (
  SELECT tick, cents + (1 << greatest(length(bin(cents)) - 8, 0)) - 1 - cents % (1 << greatest(length(bin(cents)) - 8, 0)) AS slot FROM active
), placed AS (
  SELECT tick, slot, row_number() OVER (PARTITION BY tick ORDER BY slot) AS place, count(*) OVER (PARTITION BY tick) AS n FROM slots
), times AS (
  SELECT ticks.tick // {HOUR} AS tick, coalesce(min(slot), 0) AS response_time
  FROM ticks LEFT JOIN placed ON placed.tick = ticks.tick AND place >= greatest(ceil(0.95::DOUBLE * n), 1) GROUP BY ticks.tick
), ends AS (SELECT min(e) AS lo, max(e) AS hi FROM req
), steps AS (SELECT * FROM (SELECT lo + unnest(generate_series(0, (hi - lo) // {HOUR})) * {HOUR} AS since, hi FROM ends) WHERE since < hi
), done AS (SELECT since // {HOUR} AS tick, count(e) AS operations FROM steps LEFT JOIN req ON e BETWEEN since AND since + {HOUR} GROUP BY since)
SELECT tick, response_time, operations FROM times FULL JOIN done USING (tick)""")
def job_request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: the events written as a request log, read again and reported per hour."""
    path = scratch_path(spark, "requests")
    requests(spark, sf_dir).select("start", "end", "duration").write.csv(path)
    return request_report(spark, path, 0.95, HOUR)


@query("j6_active_at_ticks", f"""{_WITHIN}
SELECT tick, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM active GROUP BY tick""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = active_at_ticks(requests(spark, sf_dir), HOUR)
    return active.groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("cents"))


_MINUTE = 60_000_000


@query("a11_throughput", f"""WITH {REQ}, ends AS (SELECT e // {_MINUTE} AS m FROM req
), span AS (SELECT min(m) AS lo, max(m) AS hi FROM ends
), ticks AS (SELECT * FROM (SELECT lo + unnest(generate_series(0, (hi - lo) // 60)) * 60 AS s, hi FROM span) WHERE s < hi)
SELECT s // 60 AS tick, count(m) AS operations FROM ticks LEFT JOIN ends ON m >= s AND m <= s + 60 GROUP BY s""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = requests(spark, sf_dir).withColumn("end", floor_div(F.col("end"), _MINUTE))
    return latency.throughput(ends, 60)


@query("p12_slo_flag", f"WITH {EV} SELECT event_id, CASE WHEN cents > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS violation FROM ev")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", slo_flag(F.col("cents"), 5000).alias("violation"))


@query("s6_load_response_times", f"""WITH {EV}
SELECT event_id, t // 1000000 AS end_epoch_s, cents / 1000.0::DOUBLE AS duration_s,
  CAST(trunc(t // 1000000 - cents / 1000.0::DOUBLE) AS BIGINT) AS start_epoch_s FROM ev""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select("event_id", F.col("ts").alias("end_ts"), F.col("cents").alias("duration_ms"))
    return latency.load_response_times(log).select("event_id", "end_epoch_s", "duration_s", "start_epoch_s")


_SERIES = EV + f""", points AS (
  SELECT user_id, t // {DAY} * 86400 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS value FROM ev GROUP BY ALL
), target AS (
  SELECT t // {DAY} * 86400 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS target FROM ev WHERE event_type = 'purchase' GROUP BY ALL
), pairs AS (SELECT user_id, value AS x, target AS y FROM points JOIN target USING (epoch_s))"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_epoch(spark, sf_dir, DAY, "user_id")


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = per_epoch(spark, sf_dir, DAY, "event_type").filter(F.col("event_type") == "purchase")
    return purchases.select("epoch_s", F.col("value").alias("target"))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.round("corr", 6).alias("corr"), "n")


@query("a12_pearson", f"""WITH {_SERIES}
SELECT user_id, round(corr(x, y), 6) AS corr, count(*) AS n FROM pairs GROUP BY user_id HAVING corr IS NOT NULL AND NOT isnan(corr)""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(co.correlate(_points(spark, sf_dir), _target(spark, sf_dir), keys=["user_id"]))


_RANKED = _SERIES + """, ranked AS (
  SELECT user_id,
    rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2.0::DOUBLE AS ry
  FROM pairs)"""


@query("a13_spearman", f"""WITH {_RANKED}
SELECT user_id, round(corr(rx, ry), 6) AS corr, count(*) AS n FROM ranked GROUP BY user_id HAVING corr IS NOT NULL AND NOT isnan(corr)""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(co.correlate(_points(spark, sf_dir), _target(spark, sf_dir), "spearman", keys=["user_id"]))


@query("w10_average_rank", f"""WITH {EV}
SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY cents)
  + (count(*) OVER (PARTITION BY event_type, cents) - 1) / 2.0::DOUBLE AS rank FROM ev""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.avg_rank(events(spark, sf_dir), ["event_type"], "cents").select("event_id", "rank")


@query("o1_rank_by_strength", f"""WITH {_SERIES}
SELECT user_id, round(corr(x, y), 6) AS corr, count(*) AS n FROM pairs GROUP BY user_id
HAVING abs(corr(x, y)) > 0.2 ORDER BY abs(corr) DESC""")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = co.correlate(_points(spark, sf_dir), _target(spark, sf_dir), min_abs=0.2, keys=["user_id"])
    return co.rank_by_strength(_scores(scores), absolute=True)


@query("o2_top_k", f"""WITH {_SERIES}
SELECT user_id, CAST(sum(x) AS DOUBLE) AS total FROM pairs GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10 OFFSET 5""")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _points(spark, sf_dir).join(_target(spark, sf_dir), "epoch_s").groupBy("user_id").agg(F.sum("value").alias("total"))
    return co.top_k(totals, [F.col("total").desc(), F.col("user_id")], 10, offset=5)


_STATS = {"max": ("max(value)", 40000.0), "mean": ("avg(value)", 10000.0), "median": ("quantile_cont(value, 0.5)", 8000.0)}


def _active(stat: str):
    expr, floor = _STATS[stat]

    @query(f"a14_active_series_{stat}", f"""WITH {_SERIES}
    SELECT user_id, epoch_s, value FROM points WHERE user_id IN (
      SELECT user_id FROM points GROUP BY user_id HAVING {expr} >= {floor})""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = co.active_series(_points(spark, sf_dir), stat, floor, keys=["user_id"])
        return kept.select("user_id", "epoch_s", "value")

    return run


for _stat in _STATS:
    _active(_stat)


@query("a15_histogram2d", f"""WITH {_SERIES}, rows AS (SELECT epoch_s // 86400 AS x, value AS y FROM points WHERE value > 0
), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rows
), cells AS (SELECT
  CAST(least(floor(CAST((x - x0) * greatest(x1 - x0, 1) AS DOUBLE) / (x1 - x0)), greatest(x1 - x0, 1) - 1) AS BIGINT) AS x_bin,
  CAST(least(floor((y - y0) * 10 / (y1 - y0)), 9) AS BIGINT) AS y_bin FROM rows, b)
SELECT x_bin, y_bin, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY x_bin) AS DOUBLE) AS frequency
FROM cells GROUP BY x_bin, y_bin""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("epoch_s", floor_div(F.col("epoch_s"), 86400))
    return co.histogram2d(points)
