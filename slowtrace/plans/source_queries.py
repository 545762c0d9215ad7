"""Queries on sources, the store and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions import addresses, labels, scalars, timebase
from slowtrace.operators.shares import taskstats_view
from slowtrace.plans.accounting_queries import _SHARES, taskstats
from slowtrace.plans.bindings import DAY, EV, events, table
from slowtrace.plans.registry import query
from slowtrace.session import scratch_path
from slowtrace.sources import metric_files, requests as req, scrape, store, targets

_IPC = {"click": "streams", "view": "sockets", "error": "streams", "purchase": "sockets", "signup": "streams"}


@query("s1_scan_metric_files", f"""WITH {EV}, m AS (
  SELECT event_type, user_id % 3 AS tid, t // 1000 AS epoch_ms, unnest(['wait', 'wait_count']) AS metric, unnest([cents, k]) AS value FROM ev)
SELECT 'thread' AS scope, 7 AS pid, tid, 'ipc' AS metric_class,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'sockets' ELSE 'streams' END AS ipc_type, length(event_type) AS part_seq, metric,
  epoch_ms // 1000 AS epoch_s, epoch_ms, CAST(value AS DOUBLE) AS value FROM m""")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the events as a metric tree, one folder per thread and kind, and scans it."""
    root = scratch_path(spark, "tree")
    ev = events(spark, sf_dir).select(
        "event_type", (F.col("user_id") % 3).alias("tid"), F.call_function("div", F.col("t"), F.lit(1000)).alias("epoch_ms"),
        F.col("cents").alias("wait"), F.col("k").alias("wait_count"),
    )
    for tid in range(3):
        for kind, ipc in _IPC.items():
            folder = f"{root}/system-metrics/thread/7/{tid}/ipc/{ipc}/{len(kind)}/{kind}"
            own = ev.filter((F.col("tid") == tid) & (F.col("event_type") == kind))
            own.select("epoch_ms", "wait", "wait_count").write.option("header", "true").csv(folder)
    points = metric_files.metric_points(spark, root)
    return points.select(
        "scope", "pid", "tid", "metric_class", "ipc_type", "part_seq", "metric", "epoch_s", "epoch_ms", "value"
    )


#: Path strings of four layouts and one that fits none.
_PATHS = """paths AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
    WHEN 1 THEN 'data/system-metrics/thread/' || l_suppkey || '/' || l_partkey || '/sched/' || l_linenumber || '.csv'
    WHEN 2 THEN 'data/system-metrics/thread/' || l_suppkey || '/' || l_partkey || '/futex/wait/' || l_linenumber || '/' || l_suppkey || '-0x' || l_partkey || '.csv'
    WHEN 3 THEN 'data/system-metrics/global/iowait/' || l_suppkey || '/' || l_partkey || '/' || l_linenumber || '/' || l_partkey || '.csv'
    WHEN 4 THEN 'data/system-metrics/global/epoll/ffff' || l_suppkey || '/sockets/' || l_linenumber || '/ipv4_' || l_partkey || '.csv'
    ELSE 'data/other/' || l_partkey || '.csv' END AS path
  FROM lineitem)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp, part, line = (F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_linenumber"))

    def path(*parts) -> F.Column:
        return F.concat(F.lit("data/"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(".csv"))

    thread = ("system-metrics/thread/", supp, "/", part)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") == 1, path(*thread, "/sched/", line))
        .when(F.col("l_linenumber") == 2, path(*thread, "/futex/wait/", line, "/", supp, "-0x", part))
        .when(F.col("l_linenumber") == 3, path("system-metrics/global/iowait/", supp, "/", part, "/", line, "/", part))
        .when(F.col("l_linenumber") == 4, path("system-metrics/global/epoll/ffff", supp, "/sockets/", line, "/ipv4_", part))
        .otherwise(path("other/", part)).alias("file_path"),
    )


@query("s2_parse_metric_path", f"""WITH {_PATHS}
SELECT l_orderkey, path AS file_path,
  CASE l_linenumber WHEN 1 THEN 'sched' WHEN 2 THEN 'futex' WHEN 3 THEN 'global_iowait' WHEN 4 THEN 'global_epoll' ELSE '-' END AS metric_class,
  CASE WHEN l_linenumber IN (1, 2) THEN 'thread' WHEN l_linenumber IN (3, 4) THEN 'global' ELSE '-' END AS scope,
  CASE WHEN l_linenumber < 4 THEN l_suppkey ELSE -1 END AS pid, CASE WHEN l_linenumber < 4 THEN l_partkey ELSE -1 END AS tid,
  CASE l_linenumber WHEN 2 THEN 'wait' WHEN 4 THEN 'sockets' ELSE '-' END AS ipc_type,
  CASE WHEN l_linenumber <= 4 THEN CAST(l_linenumber AS BIGINT) ELSE -1 END AS part_seq,
  CASE l_linenumber WHEN 2 THEN l_suppkey || '-0x' || l_partkey WHEN 3 THEN CAST(l_partkey AS VARCHAR)
    WHEN 4 THEN 'ffff' || l_suppkey || '/ipv4_' || l_partkey ELSE '-' END AS resource
FROM paths""")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = metric_files.parse_metric_path(_paths(spark, sf_dir), "v2", "keep")
    text, numbers = ["metric_class", "scope", "ipc_type", "resource"], ["pid", "tid", "part_seq"]
    return parsed.select(
        "l_orderkey", "file_path", *[F.coalesce(c, F.lit("-")).alias(c) for c in text],
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in numbers],
    )


@query("p7_series_label", f"""WITH {_PATHS}
SELECT path, regexp_replace(path, '.*thread/(\\d+)/(\\d+)/.*', '\\1/\\2') AS thread,
  coalesce(nullif(regexp_extract(path, 'wait/.*/([\\w-]+)\\.csv$', 1), ''), '-') AS futex FROM paths""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return _paths(spark, sf_dir).select(
        path.alias("path"),
        labels.series_label(path, r".*thread/(\d+)/(\d+)/.*", "$1/$2").alias("thread"),
        F.coalesce(labels.series_label(path, r"wait/.*/([\w-]+)\.csv$"), F.lit("-")).alias("futex"),
    )


@query("p8_select_series", f"""WITH {_PATHS}
SELECT path FROM paths WHERE regexp_matches(path, 'system-metrics/thread/.*/') AND NOT regexp_matches(path, '/futex/') AND NOT contains(path, '7')""")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _paths(spark, sf_dir).select(F.col("file_path").alias("path"))
    return labels.select_series(names, r"system-metrics/thread/\d+/\d+/(?!futex)", "7", col="path")


@query("s4_store_and_views", f"""WITH {_SHARES}
SELECT pid, count(*) AS n, CAST(sum(time_diff) AS BIGINT) AS time_diff, round(max(run_share), 9) AS run_share,
  round(max(uninterruptible_share), 9) AS uninterruptible_share FROM shares GROUP BY pid""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the snapshots to a store, registers its views and asks in SQL."""
    path = scratch_path(spark, "store")
    store.write_store({"taskstats": taskstats(spark, sf_dir)}, path, run_id="r1")
    store.register_views(spark, path, ["taskstats"], run_id="r1")
    return spark.sql("""
        SELECT pid, count(*) AS n, sum(time_diff) AS time_diff, round(max(run_share), 9) AS run_share,
               round(max(uninterruptible_share), 9) AS uninterruptible_share
        FROM taskstats_view GROUP BY pid""")


@query("s5_read_requests", f"WITH {EV} SELECT t AS start, t + cents AS \"end\", cents AS duration FROM ev")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "requests")
    events(spark, sf_dir).select("t", F.col("t") + F.col("cents"), "cents").write.csv(path)
    return req.read_requests(spark, path, "triple")


@query("s5_read_durations", f"WITH {EV} SELECT t AS end_us, CAST(cents AS DOUBLE) AS duration_ms FROM ev")
def s5_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "durations")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    log = events(spark, sf_dir).select(iso.alias("end_ts"), F.col("cents").alias("duration_ms"))
    log.write.option("header", "true").csv(path)
    return req.read_requests(spark, path, "duration").select(timebase.epoch_us(F.col("end_ts")).alias("end_us"), "duration_ms")


@query("s7_read_targets", f"""WITH {EV}, days AS (
  SELECT t // {DAY} AS d, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL)
SELECT 'samples' AS kind, d AS epoch_s, cents / 1000.0::DOUBLE AS a, CAST(n AS DOUBLE) AS b FROM days
UNION ALL SELECT 'cumulative', d * 86400 + 1, cents, users FROM days
UNION ALL SELECT 'test_plan', d * 86400 + 1, users, 0 FROM days
UNION ALL SELECT 'percentile', d * 86400, cents, 0 FROM days""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.call_function("div", F.col("t"), F.lit(DAY))
    days = events(spark, sf_dir).groupBy(day.alias("d")).agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )
    second, milli = F.col("d") * 86400, F.col("d") * 86_400_000 + 1999
    written = {
        "samples": [F.col("d").alias("Time (seconds)"), F.col("n").alias("Throughput (requests/second)"),
                    F.col("cents").alias("95th Percentile Latency (microseconds)")],
        "cumulative": [milli.alias("epoch_ms"), F.col("cents").alias("total_events"), F.col("users").alias("experiment_count")],
        "test_plan": [milli.alias("epoch_ms"), F.col("users").alias("user_count")],
        "percentile": [second.alias("epoch_s"), F.col("cents").alias("delay_us")],
    }
    shown = {
        "samples": ("p95_ms", "throughput"), "cumulative": ("total_events", "experiment_count"),
        "test_plan": ("user_count", None), "percentile": ("value", None),
    }
    parts = []
    for kind, columns in written.items():
        path = scratch_path(spark, kind)
        days.select(*columns).write.option("header", "true").csv(path)
        a, b = shown[kind]
        parts.append(req.read_target(spark, path, kind).select(
            F.lit(kind).alias("kind"), "epoch_s", F.col(a).cast("double").alias("a"),
            (F.col(b).cast("double") if b else F.lit(0.0)).alias("b"),
        ))
    from slowtrace.operators.series import union_parts

    return union_parts(parts)


@query("s8_parse_scrapes", f"""WITH {EV}
SELECT t // {DAY} AS scrape, CAST(sum(cents) FILTER (WHERE event_type = 'click') AS BIGINT) AS total_events,
  coalesce(arg_max(k, event_id) FILTER (WHERE event_type = 'view'), 0) AS current_experiments
FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exposition lines: clicks count, views are gauge samples, errors are comments."""
    number, user = F.col("cents").cast("string"), F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(scrape.EVENT_COUNTER + '{user="'), user, F.lit('"} '), number))
        .when(F.col("event_type") == "view", F.concat(F.lit(scrape.EXPERIMENT_GAUGE + " "), F.col("k").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("# " + scrape.EVENT_COUNTER + " "), number))
        .otherwise(F.concat(F.lit("process_seconds "), number))
    )
    lines = events(spark, sf_dir).select(
        F.call_function("div", F.col("t"), F.lit(DAY)).alias("scrape"), F.col("event_id").alias("line_no"), line.alias("line")
    )
    return scrape.parse_scrapes(lines)


_PROCS = """procs AS (SELECT c_custkey AS pid, c_mktsegment AS comm, CASE WHEN c_nationkey % 3 = 0 THEN 2097152 + c_nationkey ELSE c_nationkey END AS flags FROM customer)"""


def _procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("c_nationkey") % 3 == 0, F.lit(scalars.KTHREAD_FLAG)).otherwise(F.lit(0))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pid"), F.concat(F.lit("("), "c_mktsegment", F.lit(")")).alias("comm"),
        (F.col("c_nationkey") + flag).alias("flags"),
    )


@query("s10_select_targets_by_name", f"""WITH {_PROCS}
SELECT pid, comm, flags FROM procs WHERE regexp_matches(comm, '^BUI|URE$') AND flags < 2097152""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.select_targets(_procs(spark, sf_dir), name="^BUI|URE$")


@query("s10_select_targets_by_pid", f"""WITH {_PROCS} SELECT pid, comm, flags FROM procs WHERE pid IN (SELECT s_suppkey FROM supplier)""")
def s10_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"))
    return targets.select_targets(_procs(spark, sf_dir), pids=pids)


_OFFSET = 1_700_000_000_009_116_000


@query("p1_boot_to_epoch", f"""WITH {EV}, b AS (SELECT event_id, (t - 1704067200000000) * 1000 + k AS boot FROM ev)
SELECT event_id, boot + {_OFFSET} AS epoch_ns, boot // 1000000000 * 1000000000 + {_OFFSET} AS second_ns FROM b""")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = (F.col("t") - F.lit(1_704_067_200_000_000)) * 1000 + F.col("k")
    return events(spark, sf_dir).select(
        "event_id", timebase.boot_to_epoch(boot, _OFFSET).alias("epoch_ns"),
        timebase.boot_second_to_epoch(boot, _OFFSET).alias("second_ns"),
    )


@query("p2_split_thread_id", f"WITH {EV} SELECT event_id, user_id AS pid, event_id % 4294967296 AS tid FROM ev")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.shiftleft(F.col("user_id"), 32).bitwiseOR(F.col("event_id"))
    return events(spark, sf_dir).select("event_id", *scalars.split_tgid_pid(packed))


@query("p3_device_label", """SELECT (l_suppkey % 300) || ':' || l_partkey AS label, CAST(sum(l_suppkey % 300) AS BIGINT) AS majors,
  CAST(sum(l_partkey) AS BIGINT) AS minors FROM lineitem GROUP BY ALL""")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = scalars.encode_device(F.col("l_suppkey") % 300, F.col("l_partkey"))
    items = table(spark, sf_dir, "lineitem").select(device.alias("device"))
    return items.groupBy(scalars.device_label(F.col("device")).alias("label")).agg(
        F.sum(scalars.device_major(F.col("device"))).alias("majors"), F.sum(scalars.device_minor(F.col("device"))).alias("minors")
    )


@query("p5_normalize_futex_op", f"""WITH {EV}, o AS (SELECT event_id, k % 12 AS base FROM ev)
SELECT event_id, CASE WHEN base IN (0, 9) THEN 0 WHEN base IN (1, 10) THEN 1 ELSE -1 END AS op FROM o""")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("user_id") % 2 == 0, 128).otherwise(0) + F.when(F.col("user_id") % 3 == 0, 256).otherwise(0)
    op = scalars.normalize_futex_op((F.col("k") % 12 + flags).cast("int"))
    return events(spark, sf_dir).select("event_id", F.coalesce(op, F.lit(-1)).alias("op"))


# Families: every third event is IPv6, every seventh of an unknown family; ports only for types 1, 2 and 5.
_SOCKETS = EV + """, socks AS (
  SELECT event_id AS inode_id, user_id AS netns_cookie, CASE WHEN event_id % 7 = 0 THEN 99 WHEN event_id % 3 = 0 THEN 10 ELSE 2 END AS family,
    k % 6 AS type, cents * 65537 % 4294967296 AS src4, CASE WHEN k % 5 > 0 THEN cents * 16843009 % 4294967296 END AS dst4,
    user_id % 65536 AS a, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS b, cents % 65536 AS c FROM ev)"""


@query("p6_render_inet", f"""WITH {_SOCKETS}, words AS (
  SELECT *, lower(to_hex(a)) AS ha, lower(to_hex(b)) AS hb, lower(to_hex(c)) AS hc FROM socks WHERE family <> 99
), v6 AS (
  SELECT *, CASE WHEN a = 0 AND b = 0 THEN '2001:' WHEN b = 0 THEN '2001:' || ha || ':' ELSE '2001:' || ha || ':' || hb || ':' END
    || ':' || CASE WHEN c > 0 THEN hc ELSE '' END AS text FROM words)
SELECT inode_id, netns_cookie,
  CASE WHEN family = 2 THEN (src4 % 256) || '.' || (src4 // 256 % 256) || '.' || (src4 // 65536 % 256) || '.' || (src4 // 16777216) ELSE text END AS src_address,
  CASE WHEN type IN (1, 2, 5) THEN a ELSE 0 END AS src_port,
  CASE WHEN family = 10 OR dst4 IS NULL THEN '0.0.0.0'
    ELSE (dst4 % 256) || '.' || (dst4 // 256 % 256) || '.' || (dst4 // 65536 % 256) || '.' || (dst4 // 16777216) END AS dst_address,
  CASE WHEN type IN (1, 2, 5) THEN c % 256 * 256 + c // 256 ELSE 0 END AS dst_port FROM v6""")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    c = F.col("cents") % 65536
    b = F.when(F.col("k") % 4 == 0, F.lit(0).cast("bigint")).otherwise(F.col("k"))
    word = lambda col: F.lpad(F.hex(col.cast("bigint")), 4, "0")
    v6 = F.concat(F.lit("2001"), word(F.col("user_id") % 65536), word(b), F.lit("0" * 16), word(c))
    wrap = F.lit(4294967296)
    sockets = ev.select(
        F.col("event_id").alias("inode_id"), F.col("user_id").alias("netns_cookie"),
        F.when(F.col("event_id") % 7 == 0, 99).when(F.col("event_id") % 3 == 0, 10).otherwise(2).alias("family"),
        (F.col("k") % 6).alias("type"), (F.col("cents") * 65537 % wrap).alias("src_addr4"),
        F.when(F.col("k") % 5 > 0, F.col("cents") * 16843009 % wrap).alias("dst_addr4"),
        v6.alias("src_addr6"), F.lit(None).cast("string").alias("dst_addr6"),
        (F.col("user_id") % 65536).cast("int").alias("src_port"), c.cast("int").alias("dst_port"),
    )
    return addresses.render_inet(sockets)


@query("p6_socket_context", "WITH " + _SOCKETS + " SELECT inode_id, family, type, 6 AS protocol FROM socks WHERE family <> 99")
def p6_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    sockets = events(spark, sf_dir).select(
        F.col("event_id").alias("inode_id"),
        F.when(F.col("event_id") % 7 == 0, 99).when(F.col("event_id") % 3 == 0, 10).otherwise(2).alias("family"),
        (F.col("k") % 6).alias("type"), F.lit(6).alias("protocol"),
    )
    return addresses.socket_context(sockets)


@query("p9_clip_epoch", f"""WITH {EV}, c AS (SELECT event_id, t FROM ev WHERE t > 1705000000000000 AND t < 1706000000000000)
SELECT event_id, t - (SELECT min(t) FROM c) AS relative FROM c""")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = scalars.clip_epoch(events(spark, sf_dir), 1_705_000_000_000_000, 1_706_000_000_000_000, "t")
    return scalars.relative_epoch(clipped.select("event_id", "t"), "t", "relative").select("event_id", "relative")


@query("p11_cap_and_units", f"""WITH {EV} SELECT event_id, least(value, 50.0::DOUBLE) AS capped, cents / 1000000.0::DOUBLE AS ns_ms,
  cents / 1000.0::DOUBLE AS us_ms FROM ev""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", scalars.cap(F.col("value"), 50.0).alias("capped"), scalars.ns_to_ms(F.col("cents")).alias("ns_ms"),
        scalars.us_to_ms(F.col("cents")).alias("us_ms"),
    )


@query("w1_task_state_shares_by_process", f"WITH {_SHARES} SELECT t, tid, run_share FROM shares")
def w1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view keyed by process and thread: reused thread ids of other processes stay apart."""
    view = taskstats_view(taskstats(spark, sf_dir), keys=("pid", "tid"), cell_us=7 * DAY)
    return view.select(timebase.epoch_us(F.col("ts")).alias("t"), "tid", "run_share")
