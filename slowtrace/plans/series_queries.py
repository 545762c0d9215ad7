"""Queries on series preparation: gaps, rates, sums, alignment with a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.scalars import saturation
from slowtrace.operators import series as ts
from slowtrace.operators.carry import with_running_sum
from slowtrace.operators.ranges import time_cell
from slowtrace.plans.bindings import (
    COUNTER, DAY, EV, HOUR, SIX_HOURS_S, WEEK, counter, daily, events, orminus, per_epoch,
)
from slowtrace.plans.registry import query

_STEP = {"step": SIX_HOURS_S, "cell_rows": 28}
_KEYS = ["user_id"]

#: All series on the six-hour calendar, with the sample at or before each row.
_DENSE = COUNTER + f""", bounds AS (SELECT min(epoch_s) AS lo, max(epoch_s) AS hi FROM counter
), cal AS (SELECT unnest(generate_series(lo, hi, {SIX_HOURS_S})) AS epoch_s FROM bounds
), grid AS (
  SELECT u.user_id, c.epoch_s, p.epoch_ms, p.value
  FROM (SELECT DISTINCT user_id FROM counter) u CROSS JOIN cal c
  LEFT JOIN counter p ON p.user_id = u.user_id AND p.epoch_s = c.epoch_s)"""


def _missing(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("j2_densify", f"""WITH {_DENSE}
SELECT user_id, epoch_s, coalesce(epoch_ms, -1) AS epoch_ms, coalesce(value, -1) AS value, value IS NULL AS filled FROM grid""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = ts.densify(counter(spark, sf_dir), _KEYS, **_STEP)
    return _missing(dense).withColumn("epoch_ms", orminus("epoch_ms"))


# 2023-12-30 is before the first event, 2024-02-02 after the last
_FROM, _TO = 1703894400, 1706832000


_LONGER = _DENSE.replace(
    "SELECT min(epoch_s) AS lo, max(epoch_s) AS hi FROM counter",
    f"SELECT least(min(epoch_s), {_FROM}) AS lo, greatest(max(epoch_s), {_TO}) - 1 AS hi FROM counter",
)


@query("j2_densify_interval", f"WITH {_LONGER} SELECT user_id, epoch_s, coalesce(value, -1) AS value FROM grid")
def j2_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = ts.densify(counter(spark, sf_dir), _KEYS, interval=(_FROM, _TO), **_STEP)
    return _missing(dense).select("user_id", "epoch_s", "value")


@query("w2_fill_forward", f"""WITH {_DENSE}
SELECT user_id, epoch_s, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_s
  ROWS UNBOUNDED PRECEDING), -1) AS value FROM grid""")
def w2_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(ts.fill_forward(counter(spark, sf_dir), _KEYS, **_STEP))


_WAIT_RATE = f"""WITH {_DENSE}, held AS (
  SELECT user_id, epoch_s, coalesce(epoch_ms, epoch_s * 1000) AS ms, {{first}}
    last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_s ROWS UNBOUNDED PRECEDING) {{zero}} AS v
  FROM grid)
SELECT user_id, epoch_s, round(coalesce((v / 1e6 - lag(v / 1e6) OVER w) / nullif(ms - lag(ms) OVER w, 0), 0), 9) AS value
FROM held WINDOW w AS (PARTITION BY user_id ORDER BY epoch_s)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 9))


@query("w2_wait_rate", _WAIT_RATE.format(first="", zero=""))
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ts.wait_rate(counter(spark, sf_dir), _KEYS, **_STEP))


@query("w2_wait_rate_from_zero", _WAIT_RATE.format(first="coalesce(", zero=", 0)"))
def w2_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ts.wait_rate(counter(spark, sf_dir), _KEYS, leading_zero=True, **_STEP))


_NEAR = """ near AS (
  SELECT user_id, epoch_s,
    last_value(CASE WHEN value IS NOT NULL THEN epoch_s END IGNORE NULLS) OVER back AS e0,
    last_value(value IGNORE NULLS) OVER back AS v0, last_value(epoch_ms IGNORE NULLS) OVER back AS m0,
    first_value(CASE WHEN value IS NOT NULL THEN epoch_s END IGNORE NULLS) OVER fore AS e1,
    first_value(value IGNORE NULLS) OVER fore AS v1, first_value(epoch_ms IGNORE NULLS) OVER fore AS m1
  FROM grid WINDOW back AS (PARTITION BY user_id ORDER BY epoch_s ROWS UNBOUNDED PRECEDING),
    fore AS (PARTITION BY user_id ORDER BY epoch_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), line AS (
  SELECT user_id, epoch_s,
    CASE WHEN e0 IS NULL THEN NULL WHEN e1 IS NULL OR e0 = e1 THEN v0
         ELSE v0 + (v1 - v0) * (CAST(epoch_s - e0 AS DOUBLE) / (e1 - e0)) END AS v,
    CASE WHEN e0 IS NULL THEN NULL WHEN e1 IS NULL OR e0 = e1 THEN m0
         ELSE m0 + CAST(m1 - m0 AS DOUBLE) * (epoch_s - e0) / (e1 - e0) END AS m
  FROM near)"""


@query("w3_interpolate", f"WITH {_DENSE}, {_NEAR} SELECT user_id, epoch_s, round(coalesce(v, -1), 3) AS value FROM line")
def w3_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(ts.interpolate(counter(spark, sf_dir), _KEYS, **_STEP)).withColumn("value", F.round("value", 3))


@query("w3_sched_rate", f"""WITH {_DENSE}, {_NEAR}
SELECT user_id, epoch_s, round(coalesce((v - lag(v) OVER w) / nullif(m - lag(m) OVER w, 0), 0), 3) AS value
FROM line WINDOW w AS (PARTITION BY user_id ORDER BY epoch_s)""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ts.sched_rate(counter(spark, sf_dir), _KEYS, **_STEP)
    return rates.withColumn("value", F.round("value", 3))


@query("w4_fill_zero", f"""WITH {_DENSE} SELECT user_id, epoch_s, coalesce(value, 0) AS value FROM grid""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.fill_zero(counter(spark, sf_dir), _KEYS, **_STEP).select("user_id", "epoch_s", "value")


@query("w5_dedupe_first", f"""WITH {EV}
SELECT user_id, epoch_s, k AS part_seq, epoch_ms, event_id, cents FROM (
  SELECT *, t // {DAY} * 86400 AS epoch_s, t // 1000 AS epoch_ms,
    row_number() OVER (PARTITION BY user_id, t // {DAY} ORDER BY k, t // 1000, event_id) AS place FROM ev)
WHERE place = 1""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).select(
        "user_id", (F.col("t") - F.pmod(F.col("t"), F.lit(DAY))).alias("day"), F.col("k").alias("part_seq"),
        F.call_function("div", F.col("t"), F.lit(1000)).alias("epoch_ms"), "event_id", "cents",
    ).withColumn("epoch_s", F.call_function("div", F.col("day"), F.lit(1_000_000))).drop("day")
    return ts.dedupe_first(points, _KEYS, ["part_seq", "epoch_ms", "event_id"])


_DAILY = EV + f""", daily AS (
  SELECT user_id, event_type, t // {DAY} * 86400 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS value FROM ev GROUP BY ALL
), wide AS (
  SELECT user_id, epoch_s, max(value) FILTER (WHERE event_type = 'view') AS run,
    max(value) FILTER (WHERE event_type = 'click') AS rq, max(value) FILTER (WHERE event_type = 'error') AS block,
    max(value) FILTER (WHERE event_type = 'signup') AS gate
  FROM daily GROUP BY ALL)"""
_NAMES = ("view", "click", "error")


@query("w6_combined_rates", f"""WITH {_DAILY}
SELECT user_id, epoch_s, coalesce(run + rq, -1) AS runnable, coalesce(block + run + rq, -1) AS active_rate FROM wide""")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ts.combined_rates(daily(spark, sf_dir), _KEYS, "event_type", _NAMES)
    return rates.withColumns({c: orminus(c) for c in ("runnable", "active_rate")})


@query("w7_derived_sleep", f"""WITH {_DAILY}
SELECT user_id, epoch_s, coalesce((1 - (run + rq + block)) * CASE WHEN gate > 0 THEN 1 ELSE 0 END, -1) AS sleep_share FROM wide""")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ts.derived_sleep(daily(spark, sf_dir), _KEYS, "event_type", _NAMES, gate="signup")
    return rates.withColumn("sleep_share", orminus("sleep_share"))


@query("a8_sum_series", f"""WITH {EV} SELECT event_type, t // {DAY} * 86400 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS value
FROM ev GROUP BY ALL""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.sum_series(daily(spark, sf_dir), ["event_type"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("j1_align_wide", f"WITH {EV} SELECT t // {HOUR} * 3600 AS epoch_s, " + ", ".join(
    f"coalesce(CAST(sum(cents) FILTER (WHERE event_type = '{t}') AS DOUBLE), -1) AS {t}" for t in _TYPES
) + " FROM ev GROUP BY ALL")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ts.align_wide(per_epoch(spark, sf_dir, HOUR, "event_type"), _TYPES, col="event_type")
    return wide.select("epoch_s", *[orminus(t) for t in _TYPES])


@query("j3_join_target", f"""WITH {EV}, points AS (
  SELECT user_id, t // {HOUR} * 3600 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS value FROM ev WHERE event_type = 'click' GROUP BY ALL
), target AS (
  SELECT t // {HOUR} * 3600 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS target FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT epoch_s, coalesce(user_id, -1) AS user_id, coalesce(value, -1) AS value, coalesce(target, -1) AS target
FROM points FULL JOIN target USING (epoch_s)""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = per_epoch(spark, sf_dir, HOUR, "event_type", "user_id")
    points = hourly.filter(F.col("event_type") == "click").select("user_id", "epoch_s", "value")
    target = per_epoch(spark, sf_dir, HOUR, "event_type").filter(F.col("event_type") == "purchase").select(
        "epoch_s", F.col("value").alias("target")
    )
    joined = ts.join_target(points, target)
    return joined.select("epoch_s", orminus("user_id"), orminus("value"), orminus("target"))


@query("s3_unpivot", f"""WITH {_DAILY}
SELECT user_id, epoch_s, metric, value FROM (
  SELECT user_id, epoch_s, unnest(['run', 'rq', 'block']) AS metric, unnest([run, rq, block]) AS value FROM wide)
WHERE value IS NOT NULL""")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = daily(spark, sf_dir).groupBy("user_id", "epoch_s").agg(
        *[F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(n)
          for t, n in zip(_NAMES, ("run", "rq", "block"))]
    )
    return ts.to_long(wide, ["user_id", "epoch_s"])


@query("o3_union_parts", f"""WITH {EV}
SELECT event_id, t, cents, -1 AS k FROM ev WHERE event_type = 'click'
UNION ALL SELECT event_id, t, -1, k FROM ev WHERE event_type = 'view'""")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    clicks = ev.filter(F.col("event_type") == "click").select("event_id", "t", "cents")
    views = ev.filter(F.col("event_type") == "view").select("event_id", "t", "k")
    return ts.union_parts([clicks, views]).select("event_id", "t", orminus("cents"), orminus("k"))


@query("w9_counter_throughput", f"""WITH {EV}, hours AS (
  SELECT t // {HOUR} * 3600 AS epoch_s, count(*) AS n, count(DISTINCT user_id) AS experiment_count FROM ev GROUP BY ALL
), totals AS (
  SELECT epoch_s, experiment_count, CAST(sum(n) OVER (ORDER BY epoch_s) AS BIGINT) AS total_events FROM hours)
SELECT epoch_s, total_events, experiment_count,
  coalesce(CAST(total_events - lag(total_events) OVER w AS DOUBLE) / (epoch_s - lag(epoch_s) OVER w), -1) AS throughput,
  experiment_count * 10000 AS ideal
FROM totals WINDOW w AS (ORDER BY epoch_s)""")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.call_function("div", F.col("t") - F.pmod(F.col("t"), F.lit(HOUR)), F.lit(1_000_000))
    hours = events(spark, sf_dir).groupBy(hour.alias("epoch_s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("experiment_count")
    )
    cell = time_cell(F.col("epoch_s"), 7 * 86400)
    target = with_running_sum(hours, [], ["epoch_s"], {"total_events": "n"}, cell).drop("n")
    return ts.counter_throughput(target, cell_width=7 * 86400).withColumn("throughput", orminus("throughput"))


@query("w11_step_difference", f"""WITH {EV}
SELECT event_id, coalesce(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t), 0) AS diff FROM ev""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ts.diff(events(spark, sf_dir), _KEYS, value="cents", order="t", cell_width=WEEK)
    return steps.select("event_id", F.coalesce("diff", F.lit(0)).alias("diff"))


@query("p10_saturation", f"""WITH {EV}, steps AS (
  SELECT event_id, cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t) AS d FROM ev)
SELECT event_id, round(1 / (1 + exp(-100 * (d / 10000.0::DOUBLE + -0.9))), 9) AS saturation FROM steps WHERE d IS NOT NULL""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ts.diff(events(spark, sf_dir), _KEYS, value="cents", order="t", cell_width=WEEK)
    rate = F.col("diff") / F.lit(10000.0)
    return steps.filter(F.col("diff").isNotNull()).select("event_id", F.round(saturation(rate), 9).alias("saturation"))
