"""Queries on task shares, pairing, slicing, call statistics and poll/epoll waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.scalars import histogram_columns, log10_bucket
from slowtrace.functions.timebase import epoch_us, floor_to
from slowtrace.operators import accounting, intervals as iv, multiplex
from slowtrace.operators.carry import with_running_sum
from slowtrace.operators.ranges import time_cell
from slowtrace.operators.shares import device_share, device_totals, global_io_share, taskstats_view
from slowtrace.plans.bindings import DAY, EV, HOUR, REQ, WEEK, events, intervals, orminus, table
from slowtrace.plans.registry import query

_STATE_OF = {
    "run_time_total": "signup", "rq_time_total": "view",
    "uninterruptible_total": "click", "blkio_time_total": "error",
}


def taskstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of a thread whose counters grow by the event's value in seconds."""
    ev = events(spark, sf_dir)
    spent = F.col("cents") * F.lit(10_000_000).cast("bigint")
    grown = ev.select(
        "ts", "t", "event_id", F.col("user_id").alias("tid"),
        *[F.when(F.col("event_type") == kind, spent).otherwise(F.lit(0)).alias(f"d_{c}") for c, kind in _STATE_OF.items()],
    )
    totals = with_running_sum(
        grown, ["tid"], ["t", "event_id"], {c: f"d_{c}" for c in _STATE_OF}, time_cell(F.col("t"), WEEK)
    )
    return totals.select(
        "ts", F.call_function("div", F.col("tid"), F.lit(10).cast("bigint")).alias("pid"), "tid",
        F.concat(F.lit("user-"), F.col("tid").cast("string")).alias("comm"), *_STATE_OF,
    )


_SHARES = EV + """, snaps AS (
  SELECT t, user_id AS tid, user_id // 10 AS pid, 'user-' || user_id AS comm,
    sum(CASE WHEN event_type = 'signup' THEN cents * 10000000 ELSE 0 END) OVER w AS run,
    sum(CASE WHEN event_type = 'view' THEN cents * 10000000 ELSE 0 END) OVER w AS rq,
    sum(CASE WHEN event_type = 'click' THEN cents * 10000000 ELSE 0 END) OVER w AS unint,
    sum(CASE WHEN event_type = 'error' THEN cents * 10000000 ELSE 0 END) OVER w AS blkio
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
), steps AS (
  SELECT *, (t - lag(t) OVER v) * 1000 AS time_diff,
    CAST(run - lag(run) OVER v AS BIGINT) AS d_run, CAST(rq - lag(rq) OVER v AS BIGINT) AS d_rq,
    CAST(unint - lag(unint) OVER v AS BIGINT) AS d_unint, CAST(blkio - lag(blkio) OVER v AS BIGINT) AS d_blkio
  FROM snaps WINDOW v AS (PARTITION BY tid ORDER BY t)
), shares AS (
  SELECT t, time_diff, pid, tid, comm,
    CAST(d_run AS DOUBLE) / time_diff AS run_share, CAST(d_rq AS DOUBLE) / time_diff AS rq_share,
    CAST(d_unint AS DOUBLE) / time_diff AS uninterruptible_share, CAST(d_blkio AS DOUBLE) / time_diff AS blkio_share,
    greatest(CAST(time_diff - (d_run + d_rq + d_unint) AS DOUBLE) / time_diff, 0) AS interruptible_share
  FROM steps WHERE time_diff IS NOT NULL)"""


@query("w1_task_state_shares", f"WITH {_SHARES} SELECT * FROM shares")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = taskstats_view(taskstats(spark, sf_dir), cell_us=WEEK)
    return view.withColumn("t", epoch_us(F.col("ts"))).drop("ts")


@query("w1_task_state_shares_balanced", f"WITH {_SHARES} SELECT * FROM shares")
def w1_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of busy threads cut by number instead of time."""
    view = taskstats_view(taskstats(spark, sf_dir), cell_rows=20)
    return view.withColumn("t", epoch_us(F.col("ts"))).drop("ts")


@query("w8_split_by_bucket", f"""WITH {REQ}, sl AS (
  SELECT event_id, s, e, unnest(generate_series(s // {HOUR}, (e - 1) // {HOUR})) AS b FROM req WHERE e > s)
SELECT event_id, b * {HOUR} AS bucket, least(e, (b + 1) * {HOUR}) - greatest(s, b * {HOUR}) AS slice FROM sl""")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.split_by_bucket(intervals(spark, sf_dir), HOUR).select("event_id", "bucket", "slice")


_HIST = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN {{done}} AND {{lat}} > {low} AND {{lat}} <= {high} THEN 1 WHEN {{done}} THEN 0 END), -1) AS BIGINT) AS hist{i}"
    for i, (low, high) in enumerate(
        zip([-1] + [10 ** p for p in range(3, 10)], [10 ** p for p in range(3, 10)] + [10 ** 18])
    )
)


@query("a1_io_stats", f"""WITH {EV}, io AS (
  SELECT event_type, k % 8 AS part0, t - cents AS s, t AS e, cents AS size FROM ev)
SELECT e // {HOUR} * {HOUR} AS bucket, event_type, part0, CAST(sum(e - s) * 1000 AS BIGINT) AS total_time,
  CAST(sum(size) AS BIGINT) AS sector_cnt, count(*) AS total_requests, {_HIST.format(done='TRUE', lat='(e - s) * 1000')}
FROM io GROUP BY ALL""")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = events(spark, sf_dir).select(
        "event_type", (F.col("k") % 8).alias("part0"), (F.col("t") - F.col("cents")).alias("start"),
        F.col("t").alias("end"), F.col("cents").alias("size"),
    )
    return accounting.io_stats(done, ["event_type", "part0"], HOUR, ns_per_unit=1000)


_CALLS = f"""WITH {REQ}, sl AS (
  SELECT event_type, k % 8 AS inode, s, e, unnest(generate_series(s // {HOUR}, e // {HOUR})) AS b FROM req
), parts AS (
  SELECT *, least(e, (b + 1) * {HOUR}) - greatest(s, b * {HOUR}) AS slice, b = e // {HOUR} AS done FROM sl)"""
_CALL_STATS = f"""{_CALLS}
SELECT b * {HOUR} AS bucket, event_type, inode, CAST(sum(slice) AS BIGINT) AS total_time,
  CAST(coalesce(sum(CASE WHEN done THEN 1 END), -1) AS BIGINT) AS total_requests, {_HIST.format(done='done', lat='(e - s)')}
FROM parts WHERE slice > 0 OR done GROUP BY ALL"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).withColumn("inode", F.col("k") % 8).select("event_type", "inode", "start", "end")


def _shown(stats: DataFrame) -> DataFrame:
    counts = ["total_requests", *[f"hist{i}" for i in range(8)]]
    return stats.select("bucket", "event_type", "inode", "total_time", *[orminus(c) for c in counts])


@query("a2_call_stats", _CALL_STATS)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(accounting.call_stats(_calls(spark, sf_dir), ["event_type", "inode"], HOUR))


def completions(calls: DataFrame, bucket: int) -> DataFrame:
    """What a probe knows when a call returns: the time in the current bucket, and the count."""
    current = F.greatest(F.col("start"), floor_to(F.col("end"), bucket))
    return (
        calls.withColumn("class", log10_bucket(F.col("end") - F.col("start")))
        .groupBy(floor_to(F.col("end"), bucket).alias("bucket"), "event_type", "inode")
        .agg(F.sum(F.col("end") - current).alias("total_time"), F.count(F.lit(1)).alias("total_requests"),
             *histogram_columns("class"))
    )


@query("j7_merge_pending", _CALL_STATS)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    staging = accounting.pending_slices(calls, HOUR, "start", "end", ["event_type", "inode"])
    return _shown(
        accounting.merge_pending(completions(calls, HOUR), staging, ["bucket", "event_type", "inode"])
    )


@query("j8_new_keys", f"""{_CALLS}
SELECT b * {HOUR} AS bucket, event_type, inode, slice AS additional_time FROM parts p
WHERE NOT done AND NOT EXISTS (SELECT 1 FROM parts q WHERE q.done AND q.b = p.b AND q.event_type = p.event_type AND q.inode = p.inode)""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    staging = accounting.pending_slices(calls, HOUR, "start", "end", ["event_type", "inode"])
    return accounting.new_keys(staging, completions(calls, HOUR), ["bucket", "event_type", "inode"])


@query("p4_latency_bucket", f"""WITH {EV} SELECT event_id, CASE
  WHEN ns <= 1000 THEN 0 WHEN ns <= 10000 THEN 1 WHEN ns <= 100000 THEN 2 WHEN ns <= 1000000 THEN 3
  WHEN ns <= 10000000 THEN 4 WHEN ns <= 100000000 THEN 5 WHEN ns <= 1000000000 THEN 6 ELSE 7 END AS bucket
FROM (SELECT event_id, cents * cents * 10 AS ns FROM ev)""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.col("cents") * F.col("cents") * 10
    return events(spark, sf_dir).select("event_id", log10_bucket(ns).alias("bucket"))


@query("j4_pair_events", f"""WITH {EV}, seen AS (
  SELECT user_id, event_type, t, lag(event_type) OVER w AS pk, lag(t) OVER w AS start, lag(cents) OVER w AS cents
  FROM (SELECT * FROM ev WHERE event_type IN ('click', 'purchase'))
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, start, t AS "end", cents FROM seen WHERE event_type = 'purchase' AND pk = 'click'""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.pair_events(
        events(spark, sf_dir), ["user_id"], "click", "purchase", kind="event_type", ts="t",
        order=["t", "event_id"], payload=["cents"], cell_width=WEEK,
    )


@query("j4_pair_events_null_key", f"""WITH {EV}, owned AS (
  SELECT *, CASE WHEN user_id % 10 <> 0 THEN user_id END AS owner FROM ev WHERE event_type IN ('click', 'purchase')
), seen AS (
  SELECT owner, event_type, t, lag(event_type) OVER w AS pk, lag(t) OVER w AS start, lag(cents) OVER w AS cents
  FROM owned WINDOW w AS (PARTITION BY owner ORDER BY t, event_id))
SELECT owner, start, t AS "end", cents FROM seen WHERE event_type = 'purchase' AND pk = 'click'""")
def j4_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the users share the key NULL."""
    owned = events(spark, sf_dir).withColumn("owner", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return iv.pair_events(
        owned, ["owner"], "click", "purchase", kind="event_type", ts="t",
        order=["t", "event_id"], payload=["cents"], cell_width=WEEK,
    )


@query("j4_pair_events_balanced", f"""WITH {EV}, seen AS (
  SELECT user_id % 3 AS tenant, event_type, t, lag(event_type) OVER w AS pk, lag(t) OVER w AS start, lag(cents) OVER w AS cents
  FROM (SELECT * FROM ev WHERE event_type IN ('click', 'purchase'))
  WINDOW w AS (PARTITION BY user_id % 3 ORDER BY t, event_id))
SELECT tenant, start, t AS "end", cents FROM seen WHERE event_type = 'purchase' AND pk = 'click'""")
def j4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys hold all rows: they are cut where the rows are."""
    owned = events(spark, sf_dir).withColumn("tenant", F.col("user_id") % 3)
    return iv.pair_events(
        owned, ["tenant"], "click", "purchase", kind="event_type", ts="t",
        order=["t", "event_id"], payload=["cents"], cell_rows=200,
    )


@query("j4_open_events", f"""WITH {EV}, last AS (
  SELECT user_id, arg_max(event_type, t) AS kind, max(t) AS start FROM ev
  WHERE event_type IN ('click', 'purchase') GROUP BY user_id)
SELECT user_id, start FROM last WHERE kind = 'click'""")
def j4_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.open_events(
        events(spark, sf_dir), ["user_id"], "click", "purchase", kind="event_type", ts="t", order=["t", "event_id"]
    )


@query("a3_wake_stats", f"""WITH {EV} SELECT t // {HOUR} * {HOUR} AS bucket, k % 20 AS resource,
  count(*) AS total_requests, count(*) FILTER (WHERE k % 3 > 0) AS successful_count
FROM ev WHERE event_type = 'error' GROUP BY ALL""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    wakes = events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        "t", (F.col("k") % 20).alias("resource"), (F.col("k") % 3).alias("ret")
    )
    return accounting.wake_stats(wakes, ["resource"], HOUR, ts="t")


_KINDS = {"view": "epoll_start", "signup": "epoll_end", "click": "epoll_insert", "error": "epoll_remove"}


#: The same log as plain calls: views start and signups end a poll, clicks and errors register its files.
_POLL_KINDS = {"view": "poll_start", "signup": "poll_end", "click": "poll_register", "error": "poll_register"}


def poll_events(spark: SparkSession, sf_dir: str, kinds: dict[str, str] = _KINDS) -> DataFrame:
    """Views enter and signups leave an epoll set; clicks insert and errors remove its files."""
    return as_poll_events(events(spark, sf_dir).filter(F.col("event_type").isin(*kinds)), kinds)


def as_poll_events(ev: DataFrame, kinds: dict[str, str] = _KINDS) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return ev.select(
        kind.alias("kind"), F.col("t").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 20).alias("poll_id"), F.lit(1).cast("bigint").alias("pid"), F.col("user_id").alias("tid"),
        F.lit(0).alias("fs_magic"), F.lit(0).alias("device_id"), (F.col("k") % 10).alias("inode_id"),
    )


_MUX_KINDS = "('view', 'signup', 'click', 'error')"


def mux_sql(stop: str | None = None, poll_id: str = "user_id % 20") -> str:
    """Poll events up to ``stop``, or all with the last one as the time open waits end."""
    cut = "" if stop is None else f" AND t < {stop}"
    return EV + f""", mux AS (
  SELECT {poll_id} AS poll_id, user_id AS tid, k % 10 AS inode_id, event_type AS kind, t, event_id
  FROM ev WHERE event_type IN {_MUX_KINDS}{cut}
), last AS (SELECT {stop or 'max(t)'} AS maxt {'' if stop else 'FROM mux'}
), moves AS (
  SELECT *, lag(kind) OVER w AS pk, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lead(kind) OVER w AS nk
  FROM (SELECT * FROM mux WHERE kind IN ('view', 'signup'))
  WINDOW w AS (PARTITION BY poll_id, tid ORDER BY t, event_id))"""


def thread_wait_sql(stop: str | None = None, poll_id: str = "user_id % 20") -> str:
    return f"""WITH {mux_sql(stop, poll_id)}, waits AS (
  SELECT poll_id, tid, pt AS s, t AS e, t AS done FROM moves WHERE kind = 'signup' AND pk = 'view'
  UNION ALL
  SELECT poll_id, tid, t, coalesce(nt // {HOUR} * {HOUR}, maxt), NULL FROM moves, last
  WHERE kind = 'view' AND (nt IS NULL OR (nk = 'view' AND nt // {HOUR} * {HOUR} > t))
), sl AS (SELECT *, unnest(generate_series(s // {HOUR}, e // {HOUR})) AS b FROM waits)
SELECT b * {HOUR} AS bucket, tid, poll_id,
  CAST(sum(least(e, (b + 1) * {HOUR}) - greatest(s, b * {HOUR})) AS BIGINT) AS total_time,
  count(*) FILTER (WHERE b = done // {HOUR}) AS total_requests
FROM sl WHERE least(e, (b + 1) * {HOUR}) > greatest(s, b * {HOUR}) OR b = done // {HOUR} GROUP BY ALL"""


@query("a4_muxio_wait", thread_wait_sql())
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = multiplex.muxio_wait(poll_events(spark, sf_dir), HOUR, cell_width=WEEK)
    return waits.select("bucket", "tid", F.col("poll_id").cast("bigint"), "total_time", "total_requests")


#: A plain poll set is named by its thread, of process 1 here.
_POLLER = "4294967296 + user_id"


@query("a4_poll_wait", f"SELECT *, false AS is_epoll FROM ({thread_wait_sql(None, _POLLER)})")
def a4_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = multiplex.muxio_wait(poll_events(spark, sf_dir, _POLL_KINDS), HOUR, cell_width=WEEK)
    return waits.select("bucket", "tid", F.col("poll_id").cast("bigint"), "is_epoll", "total_time", "total_requests")


@query("a5_poll_file_wait", f"""WITH {mux_sql(None, _POLLER)}, calls AS (
  SELECT poll_id, pt AS s, t AS e FROM moves WHERE kind = 'signup' AND pk = 'view'
), still AS (SELECT poll_id, t AS s FROM moves WHERE kind = 'view' AND nt IS NULL
), regs AS (
  SELECT r.poll_id, r.inode_id, r.t, c.s, c.e FROM (SELECT * FROM mux WHERE kind IN ('click', 'error')) r
  ASOF LEFT JOIN calls c ON r.poll_id = c.poll_id AND r.t <= c.e
), waits AS (
  SELECT poll_id, inode_id, greatest(max(t), s) AS a, e AS b, e AS done FROM regs WHERE e IS NOT NULL GROUP BY poll_id, inode_id, s, e
  UNION ALL
  SELECT poll_id, inode_id, greatest(max(t), o.s), (SELECT maxt FROM last), NULL
  FROM regs JOIN still o USING (poll_id) WHERE e IS NULL GROUP BY poll_id, inode_id, o.s
), sl AS (SELECT *, unnest(generate_series(a // {HOUR}, b // {HOUR})) AS i FROM waits)
SELECT i * {HOUR} AS bucket, poll_id, false AS is_epoll, inode_id,
  CAST(sum(least(b, (i + 1) * {HOUR}) - greatest(a, i * {HOUR})) AS BIGINT) AS total_time,
  count(*) FILTER (WHERE i = done // {HOUR}) AS "count"
FROM sl WHERE least(b, (i + 1) * {HOUR}) > greatest(a, i * {HOUR}) OR i = done // {HOUR} GROUP BY ALL""")
def a5_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = multiplex.muxio_file_wait(poll_events(spark, sf_dir, _POLL_KINDS), HOUR, cell_width=WEEK)
    return waits.select("bucket", F.col("poll_id").cast("bigint"), "is_epoll", "inode_id", "total_time", "count")


def file_wait_sql(stop: str | None = None) -> str:
    return f"""WITH {mux_sql(stop)}, deltas AS (
  SELECT poll_id, t, event_id, kind, NULL AS inode_id,
    CASE WHEN kind = 'view' AND coalesce(pk, '') <> 'view' THEN 1
         WHEN kind = 'signup' AND pk = 'view' THEN -1 END AS delta
  FROM moves
  UNION ALL SELECT poll_id, t, event_id, kind, inode_id, 0 FROM mux WHERE kind IN ('click', 'error')
), line AS (
  SELECT *, sum(delta) OVER (PARTITION BY poll_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS waiting
  FROM deltas WHERE delta IS NOT NULL
), sessions AS (
  SELECT poll_id, s, e, coalesce(e, (SELECT maxt FROM last)) AS stop FROM (
    SELECT poll_id, t AS s, delta, lead(t) OVER (PARTITION BY poll_id ORDER BY t, event_id) AS e
    FROM line WHERE (delta = 1 AND waiting = 1) OR (delta = -1 AND waiting = 0)) WHERE delta = 1
), regs AS (
  SELECT * FROM (
    SELECT poll_id, inode_id, kind, t AS since, lead(t) OVER w AS until FROM (
      SELECT *, lag(kind) OVER (PARTITION BY poll_id, inode_id ORDER BY t, event_id) AS pk
      FROM line WHERE kind = 'click' OR (kind = 'error' AND waiting > 0))
    WHERE (kind = 'click' AND coalesce(pk, '') <> 'click') OR (kind = 'error' AND pk = 'click')
    WINDOW w AS (PARTITION BY poll_id, inode_id ORDER BY t, event_id)) WHERE kind = 'click'
), pairs AS (
  SELECT r.poll_id, r.inode_id, greatest(since, s) AS a, least(until, stop) AS b,
    least(until, e) AS done
  FROM regs r JOIN sessions ss ON r.poll_id = ss.poll_id AND since < stop AND (until IS NULL OR until > s)
), sl AS (SELECT *, unnest(generate_series(a // {HOUR}, b // {HOUR})) AS i FROM pairs)
SELECT i * {HOUR} AS bucket, poll_id, inode_id,
  CAST(sum(least(b, (i + 1) * {HOUR}) - greatest(a, i * {HOUR})) AS BIGINT) AS total_time,
  count(*) FILTER (WHERE i = done // {HOUR}) AS "count"
FROM sl WHERE least(b, (i + 1) * {HOUR}) > greatest(a, i * {HOUR}) OR i = done // {HOUR} GROUP BY ALL"""


@query("a5_muxio_file_wait", file_wait_sql())
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = multiplex.muxio_file_wait(poll_events(spark, sf_dir), HOUR, cell_width=WEEK)
    return waits.select("bucket", F.col("poll_id").cast("bigint"), "inode_id", "total_time", "count")


@query("j5_intersect_intervals", f"""WITH {REQ}
SELECT a.event_id AS a_id, b.event_id AS b_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end"
FROM req a JOIN req b ON a.user_id % 20 = b.user_id % 20 AND a.s < b.e AND b.s < a.e
WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = intervals(spark, sf_dir).withColumn("poll_id", F.col("user_id") % 20)

    def side(kind: str, name: str) -> DataFrame:
        return calls.filter(F.col("event_type") == kind).select(
            "poll_id", F.col("event_id").alias(f"{name}_id"),
            F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"),
        )

    return iv.intersect_intervals(side("view", "a"), side("click", "b"), ["poll_id"], 4 * HOUR).select(
        "a_id", "b_id", "start", "end"
    )


@query("j5_long_intervals", f"""WITH {REQ}, lives AS (SELECT user_id, min(s) AS s, max(e) AS e FROM req GROUP BY user_id)
SELECT r.user_id, r.event_id, greatest(l.s, r.s) AS start, least(l.e, r.e) AS "end"
FROM lives l JOIN req r ON l.user_id = r.user_id AND l.s < r.e AND r.s < l.e""")
def j5_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user within the user's whole span, which covers thousands of cells."""
    calls = intervals(spark, sf_dir)
    lives = calls.groupBy("user_id").agg(F.min("start").alias("a_start"), F.max("end").alias("a_end"))
    asked = calls.select("user_id", "event_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return iv.intersect_intervals(lives, asked, ["user_id"], HOUR).select("user_id", "event_id", "start", "end")


def sector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as block IO samples: supplier → device, part → thread, ship day → second."""
    from slowtrace.functions.timebase import epoch_us

    day = F.call_function("div", floor_to(epoch_us(F.col("l_shipdate")), DAY), F.lit(1_000_000).cast("bigint"))
    return table(spark, sf_dir, "lineitem").select(
        day.alias("epoch_s"), (F.col("l_suppkey") % 8).alias("device"), F.col("l_partkey").alias("tid"),
        F.col("l_quantity").cast("bigint").alias("sector_cnt"),
    )


_SECTORS = """sectors AS (
  SELECT epoch_us(l_shipdate) // 86400000000 * 86400 AS epoch_s, l_suppkey % 8 AS device, l_partkey AS tid,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS own
  FROM lineitem GROUP BY ALL)"""


@query("a6_device_share", f"""WITH {_SECTORS}, tot AS (
  SELECT *, CAST(sum(own) OVER (PARTITION BY epoch_s, device) AS BIGINT) AS device_total FROM sectors)
SELECT epoch_s, device, tid, own, device_total,
  CASE WHEN device_total = 0 THEN 0 ELSE CAST(own AS DOUBLE) / device_total END AS share FROM tot""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_share(sector_samples(spark, sf_dir), ["tid"])


@query("a6_device_share_null_device", f"""WITH {_SECTORS}, own AS (SELECT epoch_s, nullif(device, 1) AS device, tid, own FROM sectors), tot AS (
  SELECT *, CAST(sum(own) OVER (PARTITION BY epoch_s, device) AS BIGINT) AS device_total FROM own)
SELECT epoch_s, device, tid, own, device_total,
  CASE WHEN device_total = 0 THEN 0 ELSE CAST(own AS DOUBLE) / device_total END AS share FROM tot""")
def a6_null_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device 1 is unknown: its load is shared like that of any other."""
    samples = sector_samples(spark, sf_dir).withColumn("device", F.when(F.col("device") != 1, F.col("device")))
    return device_share(samples, ["tid"])


@query("a6_device_totals", f"""WITH {_SECTORS}
SELECT epoch_s, device, CAST(sum(own) AS BIGINT) AS device_total FROM sectors GROUP BY ALL""")
def a6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_totals(sector_samples(spark, sf_dir))


@query("a7_global_io_share", f"""WITH {_SECTORS}, tot AS (
  SELECT *, CAST(sum(own) OVER (PARTITION BY epoch_s) AS BIGINT) AS total FROM sectors)
SELECT epoch_s, device, tid, own, total, CAST(own AS DOUBLE) / total AS share FROM tot""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_io_share(sector_samples(spark, sf_dir), ["tid"])
