"""Streaming jobs over the events table, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.timebase import epoch_us
from slowtrace.operators import accounting
from slowtrace.plans.accounting_queries import (
    _CALL_STATS, _HIST, _KINDS, _MUX_KINDS, _POLL_KINDS, _POLLER, _calls, _shown, as_poll_events, completions, file_wait_sql,
    thread_wait_sql,
)
from slowtrace.plans.bindings import DAY, EV, HOUR, REQ, WEEK, events, intervals
from slowtrace.plans.registry import query
from slowtrace.plans.relation_queries import _DISCOVERED, first_user
from slowtrace.plans.bindings import orminus
from slowtrace.session import scratch_path, settle, settled_tables
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import calls, discovery, fold, late, merge, replay, stats, waits
from slowtrace.streaming.run import drain_batches, drain_stateful, drained

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


_ARRIVALS = 5


def arriving(spark: SparkSession, rows: DataFrame, at: str, name: str = "arrivals") -> DataFrame:
    """``rows`` as a stream of ``_ARRIVALS`` micro-batches of about equal size, in order of ``at`` (µs, dropped)."""
    shares = [i / _ARRIVALS for i in range(1, _ARRIVALS)]
    borders = rows.agg(F.percentile_approx(at, shares, 1000)).first()[0] or [0] * len(shares)
    path, files = scratch_path(spark, name), max(8, spark.sparkContext.defaultParallelism)
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        after = F.lit(True) if low is None else F.col(at) > low
        until = F.lit(True) if high is None else F.col(at) <= high
        rows.filter(after & until).drop(at).repartition(files).write.mode("append").parquet(path)
    return read_events_stream(spark, path, rows.drop(at).schema, max_files_per_trigger=files)


def event_stream(spark: SparkSession, sf_dir: str, disorder: int = HOUR) -> DataFrame:
    """All events, arriving up to ``disorder`` µs out of order."""
    table = spark.read.schema(_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    late = epoch_us(F.col("ts")) + F.pmod(F.xxhash64("event_id"), F.lit(disorder)) if disorder else epoch_us(F.col("ts"))
    raw = arriving(spark, table.withColumn("__at", late), "__at")
    return raw.select(
        "event_id", F.timestamp_micros(epoch_us(F.col("ts"))).alias("ts"), epoch_us(F.col("ts")).alias("t"), "user_id", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def operation_stream(spark: SparkSession, operations: DataFrame) -> DataFrame:
    """``operations(call, start, end, …)`` as raw start and end events that arrive up to an hour out of order.

    An operation whose end is NULL never ends.
    """
    moves = operations.withColumn("__move", F.explode(F.array(
        F.struct(F.col("start").alias("ts"), F.lit("start").alias("kind")),
        F.struct(F.col("end").alias("ts"), F.lit("end").alias("kind")),
    ))).select("*", "__move.ts", "__move.kind").drop("__move", "start", "end").filter("ts IS NOT NULL")
    late = F.col("ts") + F.pmod(F.xxhash64("call", "kind"), F.lit(HOUR))
    seq = F.col("call") * 2 + (F.col("kind") == "end").cast("bigint")
    with settled_tables(spark):  # each arrival reads all moves
        raw = arriving(spark, settle(moves.withColumns({"seq": seq, "__at": late})), "__at", "operations")
    return raw.withColumn("event_time", F.timestamp_micros("ts"))


@query("s11_events_stream", f"WITH {EV} SELECT event_id, t, user_id, event_type, cents, k FROM ev")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(event_stream(spark, sf_dir).drop("ts"), "events")


#: Buckets the watermark has passed: it trails the last event by the delay, in whole ms.
_CLOSED = "(b + 1) * {hour} <= (SELECT max(t) // 1000 * 1000 FROM ev) - {delay} * {hour}"


@query("t1_streaming_io_stats", f"""WITH {EV}, io AS (SELECT t // {HOUR} AS b, event_type, cents * 1000 AS ns FROM ev)
SELECT b * {HOUR} AS bucket, event_type, CAST(sum(ns) AS BIGINT) AS total_time, count(*) AS total_requests,
  {_HIST.format(done='TRUE', lat='ns')} FROM io WHERE {_CLOSED.format(hour=HOUR, delay=9)} GROUP BY ALL""")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = event_stream(spark, sf_dir).withColumn("latency_ns", F.col("cents") * 1000)
    return drained(stats.streaming_io_stats(completed, ["event_type"], "1 hour", "9 hours"), "io-stats")


@query("t2_streaming_wake_stats", f"""WITH {EV}, w AS (SELECT t // {HOUR} AS b, k % 20 AS resource, k % 3 AS ret FROM ev WHERE event_type = 'error')
SELECT b * {HOUR} AS bucket, resource, count(*) AS total_requests, count(*) FILTER (WHERE ret > 0) AS successful_count
FROM w WHERE {_CLOSED.format(hour=HOUR, delay=2).replace('FROM ev', "FROM ev WHERE event_type = 'error'")} GROUP BY ALL""")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    wakes = event_stream(spark, sf_dir).filter(F.col("event_type") == "error").select(
        "ts", (F.col("k") % 20).alias("resource"), (F.col("k") % 3).alias("ret")
    )
    return drained(stats.streaming_wake_stats(wakes, ["resource"], "1 hour", "2 hours"), "wake-stats")


#: Raw start and end rows of the calls; those of ``open`` have no end.
_MOVES = f"""WITH {REQ}, op AS (SELECT k % 8 AS inode, event_type, s, CASE WHEN event_type <> '{{open}}' THEN e END AS e FROM req),
stop AS (SELECT ((SELECT max(greatest(s, coalesce(e, s))) // 1000 * 1000 FROM op) - 2 * {HOUR}) // {HOUR} AS b),
sl AS (SELECT op.*, unnest(generate_series(s // {HOUR}, coalesce(e // {HOUR}, stop.b - 1))) AS b FROM op, stop),
parts AS (SELECT *, least(coalesce(e, (b + 1) * {HOUR}), (b + 1) * {HOUR}) - greatest(s, b * {HOUR}) AS slice,
  coalesce(b = e // {HOUR}, FALSE) AS done FROM sl WHERE b < (SELECT b FROM stop))
SELECT b * {HOUR} AS bucket, event_type, inode, CAST(sum(slice) AS BIGINT) AS total_time,
  CAST(coalesce(sum(CASE WHEN done THEN 1 END), -1) AS BIGINT) AS total_requests, {_HIST.format(done='done', lat='(e - s)')}
FROM parts WHERE slice > 0 OR done GROUP BY ALL"""


def _streamed_calls(spark: SparkSession, sf_dir: str, never_ends: str) -> DataFrame:
    operations = intervals(spark, sf_dir).select(
        F.col("event_id").alias("call"), "start", F.when(F.col("event_type") != never_ends, F.col("end")).alias("end"),
        "event_type", (F.col("k") % 8).alias("inode"))
    path = scratch_path(spark, "calls")
    slices = calls.streaming_slices(operation_stream(spark, operations), ["call"], "start", "end", HOUR, ["event_type", "inode"], "2 hours")
    drain_stateful(slices, calls.call_batches(f"{path}/stats", ["event_type", "inode"]), f"{path}/checkpoint")
    return _shown(calls.closed_buckets(spark, f"{path}/stats"))


@query("t4_streaming_calls", _MOVES.format(open=""))
def t4_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends of calls, paired in the stream: ``a2_call_stats`` up to the last closed bucket."""
    return _streamed_calls(spark, sf_dir, "")


@query("t5_streaming_open_calls", _MOVES.format(open="signup"))
def t5_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one kind never end; each closed bucket has the time they were open in it, and no request."""
    return _streamed_calls(spark, sf_dir, "signup")


@query("t1_streaming_block_io", f"""WITH {EV}, io AS (SELECT event_type, k % 8 AS part0, t - cents AS s, t AS e, cents AS size FROM ev)
SELECT e // {HOUR} * {HOUR} AS bucket, event_type, part0, CAST(sum(e - s) * 1000 AS BIGINT) AS total_time,
  CAST(sum(size) AS BIGINT) AS sector_cnt, count(*) AS total_requests, {_HIST.format(done='TRUE', lat='(e - s) * 1000')}
FROM io WHERE e // {HOUR} < ((SELECT max(e) // 1000 * 1000 FROM io) - 2 * {HOUR}) // {HOUR} GROUP BY ALL""")
def t1_block_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue and completion of block IO, paired in the stream: ``a1_io_stats`` up to the last closed bucket."""
    operations = events(spark, sf_dir).select(
        F.col("event_id").alias("call"), (F.col("t") - F.col("cents")).alias("start"), F.col("t").alias("end"), "event_type",
        (F.col("k") % 8).alias("part0"), F.col("cents").alias("size"))
    path = scratch_path(spark, "block-io")
    slices = calls.streaming_slices(operation_stream(spark, operations), ["call"], "start", "end", HOUR,
                                    ["event_type", "part0", "size"], "2 hours", open_slices=False)
    drain_stateful(slices, calls.io_batches(f"{path}/stats", ["event_type", "part0"], "size", 1000), f"{path}/checkpoint")
    return calls.closed_buckets(spark, f"{path}/stats")


@query("t2_streaming_late_rows", f"""WITH {EV}, w AS (SELECT t // {HOUR} AS b, event_type, k % 20 AS resource, k % 3 AS ret FROM ev)
SELECT b * {HOUR} AS bucket, event_type, resource, count(*) AS total_requests, count(*) FILTER (WHERE ret > 0) AS successful_count,
  TRUE AS some_late, TRUE AS some_kept
FROM w WHERE {_CLOSED.format(hour=HOUR, delay=2)} GROUP BY ALL""")
def t2_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows come up to twelve hours out of order, the delay is two: sums of closed buckets and late rows give the input."""
    wakes = event_stream(spark, sf_dir, 12 * HOUR).select(
        "ts", "event_id", "event_type", (F.col("k") % 20).alias("resource"), (F.col("k") % 3).alias("ret"))
    keys, values = ["event_type", "resource"], {"total_requests": F.lit(1), "successful_count": (F.col("ret") > 0).cast("int")}
    path = scratch_path(spark, "late")
    out = late.sums_and_late_rows(wakes, keys, values, HOUR, "2 hours", payload=["event_id"])
    drain_stateful(out, late.late_batches(path, keys, [*values]), f"{path}/checkpoint")
    kept, behind = late.closed_sums(spark, path), late.late_rows(spark, path)
    whole = kept.unionByName(behind.drop("payload")).groupBy("bucket", *keys).agg(*[F.sum(v).alias(v) for v in values])
    return whole.withColumns({"some_late": F.lit(not behind.isEmpty()), "some_kept": F.lit(not kept.isEmpty())})


def wait_events(spark: SparkSession, sf_dir: str, kinds: dict[str, str] = _KINDS) -> DataFrame:
    ev = event_stream(spark, sf_dir).filter(F.col("event_type").isin(*kinds))
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return ev.select(
        (F.col("user_id") % 20).cast("string").alias("poll_id"), F.col("ts").alias("event_time"),
        F.col("t").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.col("user_id").cast("string").alias("thread"), (F.col("k") % 10).cast("string").alias("file"),
    )


#: End of the last bucket the watermark has passed; what is open there is not counted.
_STOP = (
    f"((SELECT max(t) // 1000 * 1000 FROM ev WHERE event_type IN {_MUX_KINDS}) - 2 * {HOUR}) // {HOUR} * {HOUR}"
)
_TEXT = "CAST(poll_id AS VARCHAR) AS poll_id, CAST({name} AS VARCHAR) AS name, bucket, total_time, {count} AS total_requests"


def _machine(spark: SparkSession, sf_dir: str, kinds: dict[str, str] = _KINDS) -> DataFrame:
    return drained(waits.streaming_waits(wait_events(spark, sf_dir, kinds), HOUR, "2 hours"), "waits")


@query("t4_streaming_thread_waits", f"SELECT {_TEXT.format(name='tid', count='total_requests')} FROM ({thread_wait_sql(_STOP)})")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits.thread_waits(_machine(spark, sf_dir)).select("bucket", "name", "poll_id", "total_time", "total_requests")


@query("t5_streaming_file_waits", f"SELECT {_TEXT.format(name='inode_id', count='\"count\"')} FROM ({file_wait_sql(_STOP)})")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits.file_waits(_machine(spark, sf_dir)).select("bucket", "name", "poll_id", "total_time", "total_requests")


_EXITS = {**_KINDS, "purchase": "thread_exit"}
_EXIT_STOP = f"((SELECT max(t) // 1000 * 1000 FROM ev) - 2 * {HOUR}) // {HOUR} * {HOUR}"


_BOUNDED = f"""WITH {EV}, moves AS (
  SELECT user_id % 20 AS poll_id, user_id AS tid, event_type AS kind, t AS s, lead(t) OVER w AS nt, lead(event_type) OVER w AS nk
  FROM ev WHERE event_type IN ('view', 'signup', 'purchase') AND t < {_EXIT_STOP}
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)
), waits AS (
  SELECT poll_id, tid, s, CASE nk WHEN 'signup' THEN nt WHEN 'purchase' THEN nt WHEN 'view' THEN nt // {HOUR} * {HOUR}
    ELSE {_EXIT_STOP} END AS e, CASE WHEN nk = 'signup' THEN nt END AS done FROM moves WHERE kind = 'view'
), sl AS (SELECT *, unnest(generate_series(s // {HOUR}, e // {HOUR})) AS b FROM waits WHERE e >= s)
SELECT b * {HOUR} AS bucket, CAST(tid AS VARCHAR) AS name, CAST(poll_id AS VARCHAR) AS poll_id,
  CAST(sum(least(e, (b + 1) * {HOUR}) - greatest(s, b * {HOUR})) AS BIGINT) AS total_time, count(*) FILTER (WHERE b = done // {HOUR}) AS total_requests
FROM sl WHERE least(e, (b + 1) * {HOUR}) > greatest(s, b * {HOUR}) OR b = done // {HOUR} GROUP BY ALL"""


@query("t7_bounded_thread_waits", _BOUNDED)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases end a thread: its wait ends there, uncounted, and the thread leaves the state."""
    machine = _machine(spark, sf_dir, _EXITS)
    return waits.thread_waits(machine).select("bucket", "name", "poll_id", "total_time", "total_requests")


def _keyed_waits(spark: SparkSession, sf_dir: str, kinds: dict[str, str], quit_kind: str | None = None) -> DataFrame:
    path = scratch_path(spark, "keyed-waits")
    slices = calls.streaming_slices(
        wait_events(spark, sf_dir, kinds).withColumnRenamed("thread", "name"), ["poll_id", "name"], "epoll_start", "epoll_end", HOUR,
        ["poll_id", "name"], "2 hours", quit_kind=quit_kind)
    drain_stateful(slices, calls.wait_batches(f"{path}/waits", ["poll_id", "name"]), f"{path}/checkpoint")
    return calls.closed_buckets(spark, f"{path}/waits")


@query("t4_keyed_thread_waits", f"SELECT {_TEXT.format(name='tid', count='total_requests')} FROM ({thread_wait_sql(_STOP)})")
def t4_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per thread of a set, so that a busy set is no single task."""
    return _keyed_waits(spark, sf_dir, _KINDS)


@query("t7_keyed_thread_waits", _BOUNDED)
def t7_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where purchases end a thread."""
    return _keyed_waits(spark, sf_dir, _EXITS, "thread_exit")


def _replayed(spark: SparkSession, sf_dir: str, result: str, kinds: dict[str, str] = _KINDS) -> DataFrame:
    ev = event_stream(spark, sf_dir).filter(F.col("event_type").isin(*kinds))
    path = scratch_path(spark, "replay")
    each = replay.replay_batches(path, HOUR, 2 * HOUR, WEEK, [result])
    drain_batches(as_poll_events(ev, kinds), each, f"{path}/checkpoint")
    return replay.replayed_waits(spark, path, result)


@query("t4_replayed_poll_waits", f"SELECT *, false AS is_epoll FROM ({thread_wait_sql(_STOP, _POLLER)})")
def t4_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain poll calls in micro-batches of closed buckets."""
    return _replayed(spark, sf_dir, replay.THREADS, _POLL_KINDS).select(
        "bucket", "tid", F.col("poll_id").cast("bigint"), "is_epoll", "total_time", "total_requests")


@query("t4_replayed_thread_waits", f"SELECT {_TEXT.format(name='tid', count='total_requests')} FROM ({thread_wait_sql(_STOP)})")
def t4_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, replay.THREADS).select(
        F.col("poll_id").cast("bigint").cast("string").alias("poll_id"), F.col("tid").cast("string").alias("name"),
        "bucket", "total_time", "total_requests",
    )


@query("t5_replayed_file_waits", f"SELECT {_TEXT.format(name='inode_id', count='\"count\"')} FROM ({file_wait_sql(_STOP)})")
def t5_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, replay.FILES).select(
        F.col("poll_id").cast("bigint").cast("string").alias("poll_id"), F.col("inode_id").cast("string").alias("name"),
        "bucket", "total_time", F.col("count").alias("total_requests"),
    )


@query("t6_streaming_merge", _CALL_STATS)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late slices arrive as a stream and are merged into the completions."""
    ev = event_stream(spark, sf_dir)
    calls = ev.select(
        "event_type", (F.col("k") % 8).alias("inode"), F.col("t").alias("start"),
        (F.col("t") + F.col("cents") * F.lit(600_000).cast("bigint")).alias("end"),
    )
    path = scratch_path(spark, "merge")
    slices = accounting.pending_slices(calls, HOUR, "start", "end", ["event_type", "inode"])
    drain_batches(slices, merge.stage_batches(f"{path}/staging"), f"{path}/checkpoint")
    target = completions(_calls(spark, sf_dir), HOUR)
    return _shown(merge.merged(spark, target, f"{path}/staging", ["bucket", "event_type", "inode"]))


@query("t6_streaming_fold", _CALL_STATS)
def t6_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions and late slices arrive together; each batch runs twice, and every second one folds the table."""
    ev = event_stream(spark, sf_dir)
    stream = ev.select(
        "event_type", (F.col("k") % 8).alias("inode"), F.col("t").alias("start"),
        (F.col("t") + F.col("cents") * F.lit(600_000).cast("bigint")).alias("end"),
    )
    keys = ["bucket", "event_type", "inode"]
    path = scratch_path(spark, "folded")
    schema = completions(_calls(spark, sf_dir).limit(0), HOUR).schema
    table = fold.FoldedTable(spark, f"{path}/table", schema, keys, DAY)
    each = fold.fold_batches(
        table, lambda batch: completions(batch, HOUR),
        lambda batch: accounting.pending_slices(batch, HOUR, "start", "end", ["event_type", "inode"]), every=2)
    requests = [0]

    def twice(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id)
        each(batch, batch_id)
        # a reader between two batches sees whole versions: completed requests only grow
        seen = table.read().agg(F.sum("total_requests")).first()[0] or 0
        if seen < requests[-1]:
            raise AssertionError(f"a version lost requests: {requests[-1]} before, {seen} now")
        requests.append(seen)

    drain_batches(stream, twice, f"{path}/checkpoint")
    return _shown(table.read())


@query("t8_streaming_discovery", _DISCOVERED)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses arrive in time order, as discovery needs them."""
    stream = event_stream(spark, sf_dir, disorder=0).select(F.col("user_id").alias("pid"), F.col("k").alias("resource"), F.col("t").alias("ts"))
    path = scratch_path(spark, "discovery")
    discovery.start_state(spark, path, first_user(spark, sf_dir), "bigint")
    last = drain_batches(stream, discovery.discover_batches(path), f"{path}/checkpoint")
    return discovery.tracked_at(spark, path, last).select("pid", "discovered_at", orminus("via"))
