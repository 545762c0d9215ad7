"""Who waits for whom: locks, wakers, sockets and resource sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from slowtrace.functions.timebase import floor_div


def wait_wake_product(
    waits: DataFrame,
    wakes: DataFrame,
    waiter: int | None = None,
    waker: int | None = None,
    thread: str = "tid",
    resource: str = "resource",
    value: str = "value",
) -> DataFrame:
    """Per epoch: wait rate of the waiter × wakes by the waker, added up over locks.

    Only locks that both touch take part; where one side has no row at an epoch it
    counts 0. The two sides are stacked and summed per (lock, epoch) instead of joined,
    so a busy lock is combined on the map side.
    """
    mine = waits if waiter is None else waits.filter(F.col(thread) == waiter)
    theirs = wakes if waker is None else wakes.filter(F.col(thread) == waker)
    none = F.lit(0.0)
    stacked = mine.select(resource, "epoch_s", F.col(value).cast("double").alias("wait"), none.alias("wake")).unionAll(
        theirs.select(resource, "epoch_s", none.alias("wait"), F.col(value).cast("double").alias("wake"))
    )
    shared = shared_resources(mine, theirs, resource)
    return (
        stacked.join(shared, [resource], "left_semi")
        .groupBy(resource, "epoch_s")
        .agg(F.coalesce(F.sum("wait"), none).alias("wait"), F.coalesce(F.sum("wake"), none).alias("wake"))
        .groupBy("epoch_s")
        .agg(F.sum(F.col("wait") * F.col("wake")).alias("value"))
    )


def shared_resources(a: DataFrame, b: DataFrame, resource: str = "resource") -> DataFrame:
    """Resources on both sides, each once."""
    return a.select(resource).distinct().join(b.select(resource).distinct(), [resource], "left_semi")


def exclusive_resources(a: DataFrame, b: DataFrame, resource: str = "resource") -> DataFrame:
    """Resources of ``a`` that ``b`` never touches, each once."""
    return a.select(resource).distinct().join(b.select(resource).distinct(), [resource], "left_anti")


def exclusive_ratio(a: DataFrame, b: DataFrame, key: str = "tid") -> DataFrame:
    """One row: how many keys ``a`` has, how many of them only ``a`` has, and their ratio."""
    only_a = exclusive_resources(a, b, key).select(key, F.lit(1).alias("alone"))
    marked = a.select(key).distinct().join(only_a, [key], "left")
    alone = F.count("alone")
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        alone.alias("exclusive"),
        F.try_divide(alone.cast("double"), F.count(F.lit(1)).cast("double")).alias("ratio"),
    )


def wakers_of(
    wakes: DataFrame,
    resources: DataFrame,
    min_count: float = 1,
    keys: Sequence[str] = ("tid", "resource"),
    resource: str = "resource",
    value: str = "value",
) -> DataFrame:
    """Threads that wake one of the given resources and reach ``min_count`` in some epoch."""
    return (
        wakes.join(resources.select(resource).distinct(), [resource], "left_semi")
        .groupBy(*keys)
        .agg(F.max(value).alias("peak"), F.sum(value).alias("total"))
        .filter(F.col("peak") >= F.lit(min_count))
    )


def peer_map(pairs: DataFrame, a: str = "sock1_inode_id", b: str = "sock2_inode_id") -> DataFrame:
    """Every edge in both directions, each once."""
    both = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b)))
    return pairs.select(F.explode(both).alias("edge")).select("edge.*").distinct()


def enrich_sockets(
    waits: DataFrame,
    context: DataFrame,
    inet: DataFrame,
    peers: DataFrame,
    consts: DataFrame,
    inode: str = "inode_id",
) -> DataFrame:
    """File waits → the socket behind the inode: family, type and protocol names, endpoints, peer.

    Waits for plain files stay, with empty socket columns; a socket with several peers
    gives a row for each. The constant tables are tiny by nature; the socket tables are
    left to the measured join strategy.
    """

    def names(kind: str, code: str, label: str) -> DataFrame:
        # a value may have several names (AF_UNIX, AF_LOCAL): take the first
        return (
            consts.filter(F.col("const_type") == kind)
            .groupBy(F.col("value").alias(code))
            .agg(F.min("const_name").alias(label))
        )

    sockets = (
        context.join(names("socket_family", "family", "family_name"), ["family"], "left")
        .join(names("socket_type", "type", "type_name"), ["type"], "left")
        .join(names("family_protocol", "protocol", "protocol_name"), ["protocol"], "left")
    )
    ends = inet.select(inode, "src_address", "src_port", "dst_address", "dst_port")
    links = peers.select(F.col("sock1_inode_id").alias(inode), F.col("sock2_inode_id").alias("peer_inode_id"))
    # the small tables first: the waits, where a busy socket has most rows, are shuffled once
    known = sockets.join(ends, [inode], "full").join(links, [inode], "full")
    described = [c for c in known.columns if c != inode]
    return waits.join(known, [inode], "left").select(*waits.columns, *[known[c] for c in described])


def inventory(points: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """How many distinct children each parent has (threads of a process, locks of a thread)."""
    return (
        points.select(*parent, child).distinct().groupBy(*parent).agg(F.count(child).alias(f"n_{child}"))
    )


def inventory_sketches(
    points: DataFrame, parent: Sequence[str], child: str, ts: str, width: int, log_size: int = 12
) -> DataFrame:
    """``parent, bucket, sketch``: a sketch of the distinct children seen in each bucket of time, to be stored.

    It takes at most ``2 ** log_size`` bytes however many children there are, is filled on the map side, and can be united
    over any stretch of time, which counts of distinct children cannot. NULL children are not counted.
    """
    bucket = (floor_div(F.col(ts), width) * F.lit(width).cast("bigint")).alias("bucket")
    return points.select(*parent, bucket, child).groupBy(*parent, "bucket").agg(F.hll_sketch_agg(child, log_size).alias("sketch"))


def inventory_estimates(sketches: DataFrame, parent: Sequence[str], width: int, child: str = "children") -> DataFrame:
    """``parent, bucket, n_<child>``: about how many distinct children each parent had in buckets of ``width``.

    The relative standard error is ``1.04 / sqrt(2 ** log_size)``: 1.6 % at 12. ``parent`` may be part of the stored one:
    children are then distinct over all the rest.
    """
    bucket = (floor_div(F.col("bucket"), width) * F.lit(width).cast("bigint")).alias("bucket")
    united = sketches.select(*parent, bucket, "sketch").groupBy(*parent, "bucket").agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.select(*parent, "bucket", F.hll_sketch_estimate("sketch").alias(f"n_{child}"))


def members(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct combinations themselves."""
    return points.select(*keys).distinct()


def thread_lifetimes(taskstats: DataFrame, keys: Sequence[str] = ("pid", "tid"), ts: str = "ts") -> DataFrame:
    """First and last snapshot of each thread; fork and exit snapshots are ordinary rows."""
    return taskstats.groupBy(*keys).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("snapshots")
    )


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
