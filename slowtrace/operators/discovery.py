"""Which processes a target depends on: earliest-arrival reachability over shared resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slowtrace.operators.series import union_parts
from slowtrace.session import settle

#: Discovery time of a seed: before every event.
ALWAYS = -(1 << 62)


_MERGE_EVERY = 8


class _Known:
    """Everything found so far, as the settled increments of each round.

    Increments are only merged into one frame now and then: a round would otherwise
    write the whole state again for a few new rows.
    """

    def __init__(self, first: DataFrame, key: str, at: str):
        self._parts = [settle(first)]
        self._key, self._at = key, at

    def add(self, part: DataFrame) -> None:
        self._parts.append(part)
        if len(self._parts) >= _MERGE_EVERY:
            self._parts = [settle(self.best())]

    def best(self) -> DataFrame:
        """The earliest row of each key."""
        stacked = union_parts(self._parts)
        rest = [c for c in stacked.columns if c not in (self._key, self._at)]
        first = F.min(F.struct(self._at, *rest)).alias("__first")
        return stacked.groupBy(self._key).agg(first).select(self._key, "__first.*")

    def improvements(self, found: DataFrame) -> DataFrame:
        """Rows of ``found`` that are new, or earlier than what is known."""
        before = union_parts([p.select(self._key, self._at) for p in self._parts])
        before = before.groupBy(self._key).agg(F.min(self._at).alias("__known"))
        return (
            found.join(before, [self._key], "left")
            .filter(F.col("__known").isNull() | (F.col(self._at) < F.col("__known")))
            .drop("__known")
        )


def discover(
    accesses: DataFrame,
    seeds: DataFrame,
    peers: DataFrame | None = None,
    max_hops: int | None = None,
    registered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Processes and resources reachable from the seeds, each with its earliest time.

    ``accesses(pid, resource, ts)``: a tracked process registers the resources it touches
    from its discovery on; a process that touches a registered resource later becomes
    tracked. ``peers(a, b)``: registering a socket registers its peer at the same time.
    ``seeds(pid[, discovered_at])``.

    Returns ``(pid, discovered_at, via, hop)`` and ``(resource, registered_at)``.

    Each round only follows processes and resources whose time improved in the last one,
    so the join sides shrink to a frontier that is measured and broadcast when small; the
    state is written to the shared folder every round, and rounds stop when nothing
    improves. Times only ever decrease, so this ends without a cap; ``max_hops`` limits
    the answer to that many hops.
    """
    spark = accesses.sparkSession
    since = F.col("discovered_at") if "discovered_at" in seeds.columns else F.lit(ALWAYS)
    tracked = seeds.select(
        "pid", since.cast("bigint").alias("discovered_at"),
        F.lit(None).cast(accesses.schema["resource"].dataType).alias("via"), F.lit(0).alias("hop"),
    ).distinct()
    if registered is None:
        registered = spark.createDataFrame([], accesses.select("resource", F.col("ts").alias("registered_at")).schema)
    pids, resources = _Known(tracked, "pid", "discovered_at"), _Known(registered, "resource", "registered_at")
    touches = accesses.select("pid", "resource", "ts")
    frontier, hop = pids.best(), 0
    links = None
    if peers is not None:
        links = peers.select(F.col(peers.columns[0]).alias("resource"), F.col(peers.columns[1]).alias("__peer"))
        links = links.unionAll(links.select(F.col("__peer"), F.col("resource"))).distinct()
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = (
            touches.join(frontier.select("pid", "discovered_at"), ["pid"])
            .filter(F.col("ts") >= F.col("discovered_at"))
            .groupBy("resource")
            .agg(F.min("ts").alias("registered_at"))
        )
        if links is not None:
            peered = reached.join(links, ["resource"]).select(F.col("__peer").alias("resource"), "registered_at")
            reached = reached.unionByName(peered).groupBy("resource").agg(F.min("registered_at").alias("registered_at"))
        fresh = settle(resources.improvements(reached))
        # resources known from before act on the new accesses too
        acting = fresh.unionByName(registered) if hop == 1 else fresh
        resources.add(fresh)
        if hop > 1 and fresh.isEmpty():
            break
        found = (
            touches.join(acting, ["resource"])
            .filter(F.col("ts") > F.col("registered_at"))
            .select("pid", "ts", "resource")
            .groupBy("pid")
            .agg(F.min(F.struct(F.col("ts").alias("discovered_at"), F.col("resource").alias("via"))).alias("first"))
            .select("pid", "first.*", F.lit(hop).alias("hop"))
        )
        frontier = settle(pids.improvements(found))
        if frontier.isEmpty():
            break
        pids.add(frontier)
    return settle(pids.best()), settle(resources.best())
