"""Queries on lock relations, sockets, inventories and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.timebase import floor_div
from slowtrace.operators import relations as rel
from slowtrace.operators.discovery import ALWAYS, discover
from slowtrace.plans.bindings import DAY, EV, HOUR, events, orminus, table
from slowtrace.plans.registry import query
from slowtrace.session import settle
from slowtrace.sources.constants import build_consts


def _lock_series(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Clicks are waits and views are wakes, on one of a hundred locks, by day."""
    day = F.call_function("div", F.col("t") - F.pmod(F.col("t"), F.lit(DAY)), F.lit(1_000_000))
    return (
        events(spark, sf_dir).filter(F.col("event_type") == kind)
        .groupBy((F.col("user_id") % 7).alias("tid"), F.col("k").alias("resource"), day.alias("epoch_s"))
        .agg(F.sum("cents").cast("double").alias("value"))
    )


_LOCKS = EV + f""", locks AS (
  SELECT event_type, user_id % 7 AS tid, k AS resource, t // {DAY} * 86400 AS epoch_s, CAST(sum(cents) AS DOUBLE) AS value
  FROM ev GROUP BY ALL)"""


@query("j9_wait_wake_product", f"""WITH {_LOCKS}, a AS (SELECT * FROM locks WHERE event_type = 'click' AND tid = 1
), b AS (SELECT * FROM locks WHERE event_type = 'view' AND tid = 2
), j AS (SELECT resource, epoch_s, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y FROM a FULL JOIN b USING (resource, epoch_s)
  WHERE resource IN (SELECT resource FROM a) AND resource IN (SELECT resource FROM b))
SELECT epoch_s, sum(x * y) AS value FROM j GROUP BY epoch_s""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.wait_wake_product(
        _lock_series(spark, sf_dir, "click"), _lock_series(spark, sf_dir, "view"), waiter=1, waker=2
    )


_PAIRS = EV + """, p AS (SELECT DISTINCT event_type, user_id * 1000 + k AS resource FROM ev)"""


def _pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    ev = events(spark, sf_dir).filter(F.col("event_type") == kind)
    return ev.select((F.col("user_id") * 1000 + F.col("k")).alias("resource"))


@query("j10_shared_resources", f"""WITH {_PAIRS} SELECT resource FROM p WHERE event_type = 'click'
  INTERSECT SELECT resource FROM p WHERE event_type = 'view'""")
def j10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.shared_resources(_pairs(spark, sf_dir, "click"), _pairs(spark, sf_dir, "view"))


@query("j10_exclusive_resources", f"""WITH {_PAIRS} SELECT resource FROM p WHERE event_type = 'click'
  EXCEPT SELECT resource FROM p WHERE event_type = 'view'""")
def j10_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.exclusive_resources(_pairs(spark, sf_dir, "click"), _pairs(spark, sf_dir, "view"))


@query("j10_exclusive_ratio", f"""WITH {_PAIRS}, a AS (SELECT resource FROM p WHERE event_type = 'click'
), x AS (SELECT count(*) AS total, count(*) FILTER (WHERE resource NOT IN (SELECT resource FROM p WHERE event_type = 'view')) AS exclusive FROM a)
SELECT total, exclusive, CAST(exclusive AS DOUBLE) / total AS ratio FROM x""")
def j10_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.exclusive_ratio(_pairs(spark, sf_dir, "click"), _pairs(spark, sf_dir, "view"), key="resource")


@query("j11_wakers_of", f"""WITH {_LOCKS}, hot AS (SELECT DISTINCT k AS resource FROM ev WHERE event_type = 'error' AND cents > 20000)
SELECT tid, resource, max(value) AS peak, sum(value) AS total FROM locks
WHERE event_type = 'view' AND resource IN (SELECT resource FROM hot) GROUP BY ALL HAVING max(value) >= 10000""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = events(spark, sf_dir).filter((F.col("event_type") == "error") & (F.col("cents") > 20000))
    return rel.wakers_of(_lock_series(spark, sf_dir, "view"), hot.select(F.col("k").alias("resource")), 10000)


@query("o4_intersect", f"""WITH {EV} SELECT user_id, k FROM ev WHERE event_type = 'click'
  INTERSECT SELECT user_id, k FROM ev WHERE event_type = 'purchase'""")
def o4_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    side = lambda kind: ev.filter(F.col("event_type") == kind).select("user_id", "k")
    return rel.intersect(side("click"), side("purchase"))


@query("o4_difference", f"""WITH {EV} SELECT user_id, k FROM ev WHERE event_type = 'click'
  EXCEPT SELECT user_id, k FROM ev WHERE event_type = 'purchase'""")
def o4_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    side = lambda kind: ev.filter(F.col("event_type") == kind).select("user_id", "k")
    return rel.difference(side("click"), side("purchase"))


@query("a16_inventory", f"WITH {EV} SELECT user_id, event_type, count(DISTINCT k) AS n_k FROM ev GROUP BY ALL")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.inventory(events(spark, sf_dir), ["user_id", "event_type"], "k")


@query("a16_inventory_sketches", f"""WITH {EV}
SELECT event_type, t // {DAY} * {DAY} AS bucket, count(DISTINCT event_id) AS n_events, TRUE AS within FROM ev GROUP BY ALL""")
def a16_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day from sketches stored per hour and user: the exact number, and whether the estimate is near (4 sigma)."""
    log = events(spark, sf_dir)
    stored = settle(rel.inventory_sketches(log, ["user_id", "event_type"], "event_id", "t", HOUR))
    near = rel.inventory_estimates(stored, ["event_type"], DAY, "near")
    day = log.withColumn("bucket", floor_div(F.col("t"), DAY) * F.lit(DAY).cast("bigint"))
    exact = rel.inventory(day, ["event_type", "bucket"], "event_id").withColumnRenamed("n_event_id", "n_events")
    off = F.abs(F.col("n_near") - F.col("n_events"))
    return exact.join(near, ["event_type", "bucket"]).select(
        "event_type", "bucket", "n_events", (off <= F.greatest(F.lit(1.0), 0.065 * F.col("n_events"))).alias("within"))


@query("a16_members", f"WITH {EV} SELECT DISTINCT user_id, event_type, k FROM ev")
def a16_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.members(events(spark, sf_dir), ["user_id", "event_type", "k"])


@query("a17_thread_lifetimes", f"""WITH {EV} SELECT user_id // 10 AS pid, user_id AS tid, min(t) AS first_seen, max(t) AS last_seen,
  count(*) AS snapshots FROM ev GROUP BY ALL""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = events(spark, sf_dir).select(
        F.call_function("div", F.col("user_id"), F.lit(10).cast("bigint")).alias("pid"), F.col("user_id").alias("tid"), "t"
    )
    return rel.thread_lifetimes(snaps, ts="t")


_EDGES = "SELECT DISTINCT l_suppkey AS a, 100000 + l_partkey % 100 AS b FROM lineitem"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sock1_inode_id"), (F.lit(100_000) + F.col("l_partkey") % 100).alias("sock2_inode_id")
    )


@query("j12_peer_map", f"""WITH e AS ({_EDGES})
SELECT a AS sock1_inode_id, b AS sock2_inode_id FROM e UNION SELECT b, a FROM e""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.peer_map(_edges(spark, sf_dir))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named constants out of the dimension tables, with some that are none."""
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    return (
        nation.select(F.concat(F.lit("AF_"), "n_name").alias("identifier"), F.col("n_nationkey").alias("value"))
        .unionAll(nation.select(F.concat(F.lit("IPPROTO_"), "n_name"), F.col("n_nationkey")))
        .unionAll(region.select(F.concat(F.lit("sock_type_SOCK_"), "r_name"), F.col("r_regionkey")))
        .unionAll(customer.select(F.col("c_name"), F.col("c_nationkey")))
    )


_CONSTS = """SELECT 'socket_type' AS const_type, 'SOCK_' || r_name AS const_name, r_regionkey AS value FROM region
  UNION ALL SELECT 'socket_family', 'AF_' || n_name, n_nationkey FROM nation
  UNION ALL SELECT 'family_protocol', 'IPPROTO_' || n_name, n_nationkey FROM nation"""


@query("s9_build_consts", _CONSTS)
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_consts(identifiers(spark, sf_dir))


@query("j13_enrich_sockets", f"""WITH {EV}, consts AS ({_CONSTS}), waits AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN -user_id ELSE user_id END AS inode_id, cents AS total_time FROM ev
), ctx AS (SELECT c_custkey AS inode_id, c_nationkey AS family, c_nationkey % 5 AS type, c_nationkey AS protocol FROM customer
), inet AS (SELECT c_custkey AS inode_id, c_name AS src_address, c_nationkey AS src_port, c_mktsegment AS dst_address, c_nationkey + 1 AS dst_port FROM customer
), peers AS (SELECT DISTINCT s_suppkey AS a, s_nationkey AS b FROM supplier)
SELECT event_id, w.inode_id, total_time, coalesce(family, -1) AS family, coalesce(f.const_name, '-') AS family_name,
  coalesce(ty.const_name, '-') AS type_name, coalesce(pr.const_name, '-') AS protocol_name,
  coalesce(src_address, '-') AS src_address, coalesce(dst_address, '-') AS dst_address, coalesce(b, -1) AS peer_inode_id
FROM waits w LEFT JOIN ctx USING (inode_id) LEFT JOIN inet USING (inode_id) LEFT JOIN peers ON peers.a = w.inode_id
  LEFT JOIN consts f ON f.const_type = 'socket_family' AND f.value = family
  LEFT JOIN consts ty ON ty.const_type = 'socket_type' AND ty.value = type
  LEFT JOIN consts pr ON pr.const_type = 'family_protocol' AND pr.value = protocol""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    # errors stand for waits on plain files, which have no socket
    inode = F.when(F.col("event_type") == "error", -F.col("user_id")).otherwise(F.col("user_id"))
    waits = events(spark, sf_dir).select("event_id", inode.alias("inode_id"), F.col("cents").alias("total_time"))
    customer, nation = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    context = customer.select(
        F.col("c_custkey").alias("inode_id"), nation.alias("family"), (nation % 5).alias("type"), nation.alias("protocol")
    )
    inet = customer.select(
        F.col("c_custkey").alias("inode_id"), F.col("c_name").alias("src_address"), nation.alias("src_port"),
        F.col("c_mktsegment").alias("dst_address"), (nation + 1).alias("dst_port"),
    )
    peers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sock1_inode_id"), F.col("s_nationkey").alias("sock2_inode_id")
    ).distinct()
    rich = rel.enrich_sockets(waits, context, inet, peers, build_consts(identifiers(spark, sf_dir)))
    text = ["family_name", "type_name", "protocol_name", "src_address", "dst_address"]
    return rich.select(
        "event_id", "inode_id", "total_time", orminus("family"), orminus("peer_inode_id"),
        *[F.coalesce(c, F.lit("-")).alias(c) for c in text],
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses of a process to one of a hundred resources."""
    return events(spark, sf_dir).select(F.col("user_id").alias("pid"), F.col("k").alias("resource"), F.col("t").alias("ts"))


def first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.min("user_id").alias("pid"))


# An access is active once its process is tracked or its resource registered by an
# earlier access, so activity follows the next access of the same process or resource.
REACHED = EV + """, acc AS (
  SELECT event_id, user_id AS pid, k AS resource, t, lead(event_id) OVER (PARTITION BY user_id ORDER BY t) AS next_of_pid,
    lead(event_id) OVER (PARTITION BY k ORDER BY t) AS next_of_resource
  FROM ev
), active AS (
  SELECT event_id, pid, resource, t, next_of_pid, next_of_resource FROM acc WHERE pid = (SELECT min(user_id) FROM events)
  UNION SELECT n.event_id, n.pid, n.resource, n.t, n.next_of_pid, n.next_of_resource
  FROM active a JOIN acc n ON n.event_id = a.next_of_pid OR n.event_id = a.next_of_resource
)"""

_DISCOVERED = f"""WITH RECURSIVE {REACHED}
SELECT pid, min(t) AS discovered_at, arg_min(resource, t) AS via FROM active WHERE pid <> (SELECT min(user_id) FROM events) GROUP BY pid
UNION ALL SELECT min(user_id), {ALWAYS}, -1 FROM events"""


@query("j14_discover", _DISCOVERED)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked, _ = discover(accesses(spark, sf_dir), first_user(spark, sf_dir))
    return tracked.select("pid", "discovered_at", orminus("via"))


@query("j14_registered_resources", f"""WITH RECURSIVE {REACHED}
SELECT resource, min(t) AS registered_at FROM active GROUP BY resource""")
def j14_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover(accesses(spark, sf_dir), first_user(spark, sf_dir))[1]
