"""Shares of wall time per scheduling state, and shares of device load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.timebase import epoch_us
from slowtrace.operators.carry import with_balanced_cells, with_neighbours
from slowtrace.operators.keys import join_groups
from slowtrace.operators.ranges import time_cell

US_PER_HOUR = 3_600_000_000

_STATES = {
    "run": "run_time_total",
    "rq": "rq_time_total",
    "uninterruptible": "uninterruptible_total",
    "blkio": "blkio_time_total",
}


def taskstats_view(
    taskstats: DataFrame,
    keys: Sequence[str] = ("tid",),
    cell_us: int | None = US_PER_HOUR,
    cell_rows: int | None = None,
) -> DataFrame:
    """Share of the time between two snapshots a thread spent in each state.

    A thread is cut every ``cell_us`` or, with ``cell_rows``, into stretches of about so many snapshots.

    The first snapshot of a thread has no predecessor and is dropped. Block IO is part
    of the uninterruptible time, so it is not subtracted again. A counter that went
    backwards (a reused thread id) gives a NULL share rather than a wrapped one.
    """
    stamped = taskstats.withColumn("__us", epoch_us(F.col("ts")))
    taken = {"__us_last": "__us", **{f"__last_{s}": c for s, c in _STATES.items()}}
    cell = None if cell_us is None else time_cell(F.col("__us"), cell_us)
    needed = dict.fromkeys(["ts", "__us", "pid", "tid", "comm", *keys, *_STATES.values()])
    stamped = stamped.select(*needed)
    if cell_rows is not None:
        stamped, cell = with_balanced_cells(stamped, keys, "__us", cell_rows), F.col("__balanced")
    seen = with_neighbours(stamped, keys, ["__us"], cell, previous=taken)
    spent = {s: F.col(c) - F.col(f"__last_{s}") for s, c in _STATES.items()}
    deltas = seen.filter(F.col("__us_last").isNotNull()).select(
        "ts",
        ((F.col("__us") - F.col("__us_last")) * F.lit(1000).cast("bigint")).alias("time_diff"),
        "pid", "tid", "comm",
        *[F.when(delta >= 0, delta).alias(s) for s, delta in spent.items()],
    )

    def share(amount: Column) -> Column:
        return F.try_divide(amount.cast("double"), F.col("time_diff").cast("double"))

    rest = F.col("time_diff") - (F.col("run") + F.col("rq") + F.col("uninterruptible"))
    return deltas.select(
        "ts", "time_diff", "pid", "tid", "comm",
        share(F.col("run")).alias("run_share"),
        share(F.col("rq")).alias("rq_share"),
        share(F.col("uninterruptible")).alias("uninterruptible_share"),
        share(F.col("blkio")).alias("blkio_share"),
        F.when(rest.isNotNull(), F.greatest(share(rest), F.lit(0.0))).alias("interruptible_share"),
    )


def device_share(
    samples: DataFrame,
    thread_keys: Sequence[str] = ("pid", "tid"),
    device: str = "device",
    epoch: str = "epoch_s",
    amount: str = "sector_cnt",
) -> DataFrame:
    """Each thread's part of a device's load per epoch, next to the device total.

    Totals are summed from the already reduced per-thread rows and joined back; a window
    over (epoch, device) would hold all threads of a busy device in one task.
    """
    own = samples.groupBy(epoch, device, *thread_keys).agg(F.sum(amount).alias("own"))
    totals = own.groupBy(epoch, device).agg(F.sum("own").alias("device_total"))
    share = F.coalesce(F.try_divide(F.col("own").cast("double"), F.col("device_total").cast("double")), F.lit(0.0))
    return join_groups(own, totals, [epoch, device]).withColumn("share", share)


def global_io_share(
    samples: DataFrame,
    thread_keys: Sequence[str] = ("pid", "tid"),
    device: str = "device",
    epoch: str = "epoch_s",
    amount: str = "sector_cnt",
) -> DataFrame:
    """Each (thread, device)'s part of the load of all devices per epoch."""
    own = samples.groupBy(epoch, device, *thread_keys).agg(F.sum(amount).alias("own"))
    totals = own.groupBy(epoch).agg(F.sum("own").alias("total"))
    share = F.try_divide(F.col("own").cast("double"), F.col("total").cast("double"))
    return join_groups(own, totals, [epoch]).withColumn("share", share)


def device_totals(samples: DataFrame, device: str = "device", epoch: str = "epoch_s", amount: str = "sector_cnt") -> DataFrame:
    """Load of each device per epoch over all threads."""
    return samples.groupBy(epoch, device).agg(F.sum(amount).alias("device_total"))
