"""Time-series preparation on the long model: one row per (series, epoch).

Gaps are filled *after* the only shuffle. Each sample learns its neighbours with one
carried window and then grows its own filler rows, so calendar rows are never joined
or shuffled, and forward fill, interpolation and rates have closed forms per gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.timebase import floor_div
from slowtrace.operators.carry import with_neighbours
from slowtrace.operators.keys import join_groups
from slowtrace.operators.ranges import explode_range, time_cell

SERIES = ("series_id",)
CELL_ROWS = 4096

# Counters that are interpolated, and counters that hold their last value.
INTERPOLATED = ["runtime", "rq_time", "sleep_time", "block_time", "iowait_time"]
HELD = ["socket_wait", "stream_wait", "futex_wait_ns"]
#: Counts per second: no row means 0.
COUNTED = ["futex_count", "sector_cnt"]


def dedupe_first(
    points: DataFrame, keys: Sequence[str] = SERIES, order: Sequence[str] = ("part_seq", "epoch_ms")
) -> DataFrame:
    """One row per (series, epoch): the first by partition file, then by time."""
    rest = [c for c in points.columns if c not in (*keys, "epoch_s")]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return points.groupBy(*keys, "epoch_s").agg(first.alias("__first")).select(
        *keys, "epoch_s", "__first.*"
    ).select(*points.columns)


def align_wide(points: DataFrame, series: Sequence[str], col: str = "series_id") -> DataFrame:
    """The wide frame at the edge: one row per epoch, one column per named series."""
    return (
        points.filter(F.col(col).isin(*series))
        .groupBy("epoch_s")
        .pivot(col, list(series))
        .agg(F.first("value", ignorenulls=True))
    )


def _calendar(
    known: DataFrame, points: DataFrame, interval: tuple[int, int] | None, frame: Sequence[str]
) -> tuple[DataFrame, Column, Column]:
    """The calendar bounds of the frame next to each row of ``known``.

    Without an interval the calendar is [min, max]; with one it is
    [min(min, a), max(max, b)), its end left out.
    """
    low, high = F.min("epoch_s"), F.max("epoch_s")
    if interval is not None:
        low, high = F.least(low, F.lit(interval[0])), F.greatest(high, F.lit(interval[1])) - F.lit(1)
    bounds = points.groupBy(*frame).agg(low.alias("__lo"), high.alias("__hi"))
    if frame:
        return join_groups(known, bounds, frame), F.col("__lo"), F.col("__hi")
    # as columns of their own: each bound is one subquery however often it is used later
    bounded = known.withColumns({c: bounds.select(c).scalar() for c in ("__lo", "__hi")})
    return bounded, F.col("__lo"), F.col("__hi")


def expand(
    points: DataFrame,
    keys: Sequence[str] = SERIES,
    interval: tuple[int, int] | None = None,
    step: int = 1,
    frame: Sequence[str] = (),
    cell_rows: int | None = CELL_ROWS,
) -> DataFrame:
    """Every series on the dense calendar, each row still knowing its sample and neighbours.

    Adds ``at`` (the calendar epoch) next to the sample's own columns, ``prev_*`` and
    ``next_*``. A row is the sample itself where ``at == epoch_s``, leads the series
    where ``at < epoch_s`` and trails its sample where ``at > epoch_s``; ``led`` marks a
    first sample that comes after the start of the calendar. Epochs must be
    multiples of ``step``. Points without a value are not samples and are dropped.
    """
    samples = points.filter(F.col("value").isNotNull()).withColumn(
        "epoch_ms",
        F.coalesce("epoch_ms", F.col("epoch_s") * F.lit(1000)) if "epoch_ms" in points.columns
        else F.col("epoch_s") * F.lit(1000),
    )
    taken = ("epoch_s", "epoch_ms", "value")
    cell = None if cell_rows is None else time_cell(F.col("epoch_s"), cell_rows * step)
    known = with_neighbours(
        samples, keys, ["epoch_s"], cell,
        previous={f"prev_{c}": c for c in taken}, following={f"next_{c}": c for c in taken},
    )
    placed, low, high = _calendar(known, points, interval, frame)
    own = floor_div(F.col("epoch_s"), step)
    led = F.col("prev_epoch_s").isNull() & (floor_div(low, step) < own)
    placed = placed.withColumn("led", led)
    first = F.when(F.col("led"), floor_div(low, step)).otherwise(own)
    last = F.coalesce(
        floor_div(F.col("next_epoch_s"), step) - F.lit(1), F.greatest(floor_div(high, step), own)
    )
    grown = explode_range(placed, first, last, "__at")
    return grown.withColumn("at", F.col("__at") * F.lit(step).cast("bigint")).drop("__at", "__lo", "__hi")


def _is_sample() -> Column:
    return F.col("at") == F.col("epoch_s")


def _leads() -> Column:
    return F.col("at") < F.col("epoch_s")


def densify(points: DataFrame, keys: Sequence[str] = SERIES, **calendar) -> DataFrame:
    """Series on the dense calendar; filler rows have no value and ``filled`` set."""
    return expand(points, keys, **calendar).select(
        *keys,
        F.col("at").alias("epoch_s"),
        F.when(_is_sample(), F.col("epoch_ms")).alias("epoch_ms"),
        F.when(_is_sample(), F.col("value")).alias("value"),
        (~_is_sample()).alias("filled"),
    )


def fill_zero(points: DataFrame, keys: Sequence[str] = SERIES, **calendar) -> DataFrame:
    """Counts: a second without a row counts 0."""
    return densify(points, keys, **calendar).withColumn("value", F.coalesce("value", F.lit(0.0)))


def fill_forward(points: DataFrame, keys: Sequence[str] = SERIES, **calendar) -> DataFrame:
    """Fillers hold the last value; rows before the first sample stay empty."""
    return expand(points, keys, **calendar).select(
        *keys, F.col("at").alias("epoch_s"), F.when(~_leads(), F.col("value")).alias("value")
    )


def interpolate(points: DataFrame, keys: Sequence[str] = SERIES, **calendar) -> DataFrame:
    """Linear between samples; after the last one its value holds, before the first nothing."""
    share = F.try_divide(F.col("at") - F.col("epoch_s"), F.col("next_epoch_s") - F.col("epoch_s"))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * share
    return expand(points, keys, **calendar).select(
        *keys,
        F.col("at").alias("epoch_s"),
        F.when(~_leads(), F.coalesce(line, F.col("value"))).alias("value"),
    )


def _held_rate(scale: float, zero_first: Column, step: int) -> Column:
    one_before = F.col("epoch_s") - F.lit(step)
    adjacent = F.col("prev_epoch_s") == one_before
    elapsed = F.col("epoch_ms") - F.when(adjacent, F.col("prev_epoch_ms")).otherwise(one_before * F.lit(1000))
    before = F.when(F.col("prev_epoch_s").isNotNull(), F.col("prev_value")).when(
        zero_first & F.col("led"), F.lit(0.0)
    )
    rate = F.try_divide(F.col("value") / F.lit(scale) - before / F.lit(scale), elapsed.cast("double"))
    return F.coalesce(F.when(_is_sample(), rate), F.lit(0.0))


def _linear_rate() -> Column:
    arrive = F.try_divide(
        F.col("value") - F.col("prev_value"), (F.col("epoch_ms") - F.col("prev_epoch_ms")).cast("double")
    )
    leave = F.try_divide(
        F.col("next_value") - F.col("value"), (F.col("next_epoch_ms") - F.col("epoch_ms")).cast("double")
    )
    return F.coalesce(F.when(_is_sample(), arrive).when(~_leads(), leave), F.lit(0.0))


def wait_rate(
    points: DataFrame,
    keys: Sequence[str] = SERIES,
    scale: float = 1e6,
    leading_zero: bool | Column = False,
    step: int = 1,
    **calendar,
) -> DataFrame:
    """Rate of a cumulative wait counter (ns) that holds its value between samples.

    The dense row before a sample is either the previous sample or a filler that holds
    its value at a whole second, hence two denominators. Fillers do not change, so
    their rate is 0. ``leading_zero`` says that the counter was 0 before its first sample.
    """
    zero_first = leading_zero if isinstance(leading_zero, Column) else F.lit(leading_zero)
    return expand(points, keys, step=step, **calendar).select(
        *keys, F.col("at").alias("epoch_s"), _held_rate(scale, zero_first, step).alias("value")
    )


def sched_rate(points: DataFrame, keys: Sequence[str] = SERIES, **calendar) -> DataFrame:
    """Rate of a cumulative time counter (ms) that grows linearly between samples.

    Value and clock are both interpolated over the same rows, so every row of a gap has
    the rate of the whole gap. Rows before the first sample, the first sample and rows
    after the last one have rate 0.
    """
    return expand(points, keys, **calendar).select(
        *keys, F.col("at").alias("epoch_s"), _linear_rate().alias("value")
    )


def derive_rates(
    points: DataFrame,
    keys: Sequence[str] = ("scope", "pid", "tid", "comm", "metric_class", "ipc_type", "resource", "metric"),
    step: int = 1,
    **calendar,
) -> DataFrame:
    """All derived series of a metric tree in one pass over its points.

    Time counters become linear rates, wait counters held rates (from 0 for global and
    lock waits), and counts are filled with 0; other metrics are dropped. The calendar is
    that of all points, and the points are shuffled once for all families together.
    """
    metric = F.col("metric")
    linear, held, counts = metric.isin(*INTERPOLATED), metric.isin(*HELD), metric.isin(*COUNTED)
    zero_first = (F.col("scope") == "global") | (metric == "futex_wait_ns")
    # series without a pid or a command still need a key that joins
    filled = points.withColumns({
        c: F.coalesce(F.col(c), F.lit(-1) if c in ("pid", "tid") else F.lit("")) for c in keys
    })
    grown = expand(filled, keys, step=step, **calendar).filter(linear | held | counts)
    value = (
        F.when(linear, _linear_rate())
        .when(held, _held_rate(1e6, zero_first, step))
        .otherwise(F.when(_is_sample(), F.col("value")).otherwise(F.lit(0.0)))
    )
    name = F.when(counts, metric).otherwise(F.concat(F.regexp_replace(metric, "_ns$", ""), F.lit("_rate")))
    return grown.select(
        *[
            F.when(F.col(c) != (F.lit(-1) if c in ("pid", "tid") else F.lit("")), F.col(c)).alias(c)
            for c in keys if c != "metric"
        ],
        name.alias("metric"), F.col("at").alias("epoch_s"), value.alias("value"),
    )


def diff(
    points: DataFrame,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    out: str = "diff",
    order: str = "epoch_s",
    cell_width: int | None = CELL_ROWS,
) -> DataFrame:
    """Step-to-step difference of a series; the first row has none."""
    cell = None if cell_width is None else time_cell(F.col(order), cell_width)
    seen = with_neighbours(points, keys, [order], cell, previous={"__before": value})
    return seen.withColumn(out, F.col(value) - F.col("__before")).drop("__before")


def counter_throughput(
    target: DataFrame,
    keys: Sequence[str] = (),
    total: str = "total_events",
    epoch: str = "epoch_s",
    experiments: str | None = "experiment_count",
    per_experiment: int = 10_000,
    cell_width: int | None = CELL_ROWS,
) -> DataFrame:
    """Throughput of a cumulative counter, and the ideal one next to it."""
    cell = None if cell_width is None else time_cell(F.col(epoch), cell_width)
    seen = with_neighbours(
        target, keys, [epoch], cell, previous={"__total": total, "__epoch": epoch}
    )
    measured = F.try_divide(
        (F.col(total) - F.col("__total")).cast("double"), (F.col(epoch) - F.col("__epoch")).cast("double")
    )
    result = seen.withColumn("throughput", measured).drop("__total", "__epoch")
    if experiments is None:
        return result
    return result.withColumn("ideal", F.col(experiments) * F.lit(per_experiment))


def _metric(name: str, col: str) -> Column:
    return F.max(F.when(F.col(col) == name, F.col("value")))


def combined_rates(
    rates: DataFrame,
    keys: Sequence[str] = ("pid", "tid"),
    metric: str = "metric",
    names: tuple[str, str, str] = ("runtime_rate", "rq_time_rate", "block_time_rate"),
) -> DataFrame:
    """``runnable`` = run + runqueue and ``active_rate`` = block + run + runqueue per thread and epoch."""
    run, rq, block = (_metric(n, metric) for n in names)
    return (
        rates.groupBy(*keys, "epoch_s")
        .agg(run.alias("run"), rq.alias("rq"), block.alias("block"))
        .select(
            *keys,
            "epoch_s",
            (F.col("run") + F.col("rq")).alias("runnable"),
            (F.col("block") + F.col("run") + F.col("rq")).alias("active_rate"),
        )
    )


def derived_sleep(
    rates: DataFrame,
    keys: Sequence[str] = ("pid", "tid"),
    metric: str = "metric",
    names: tuple[str, str, str] = ("runtime_rate", "rq_time_rate", "block_time_rate"),
    gate: str | None = None,
) -> DataFrame:
    """Sleep share ``1 − (run + rq + block)``; with ``gate``, 0 where that rate is not positive."""
    run, rq, block = (_metric(n, metric) for n in names)
    gated = [] if gate is None else [_metric(gate, metric).alias("__gate")]
    wide = rates.groupBy(*keys, "epoch_s").agg(run.alias("run"), rq.alias("rq"), block.alias("block"), *gated)
    sleep = F.lit(1.0) - (F.col("run") + F.col("rq") + F.col("block"))
    if gate is not None:
        sleep = sleep * F.coalesce(F.col("__gate") > 0, F.lit(False)).cast("double")
    return wide.select(*keys, "epoch_s", sleep.alias("sleep_share"))


def sum_series(points: DataFrame, group_keys: Sequence[str] = ()) -> DataFrame:
    """Series added up by epoch; a series without a row at an epoch adds 0."""
    return points.groupBy(*group_keys, "epoch_s").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")
    )


def join_target(points: DataFrame, target: DataFrame, on: Sequence[str] = ("epoch_s",)) -> DataFrame:
    """Full outer join of all points with the target series.

    Written as a left join plus the target rows no point has: a full outer join would
    force a shuffle of all points, while this one broadcasts a target that is measured
    to be small.
    """
    on = list(on)
    matched = points.join(target, on, "left")
    unmatched = target.join(points.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Partition files stacked by column name; columns a part lacks are NULL."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Metric columns to rows (``metric``, ``value``); missing cells give no row."""
    metrics = list(metrics or [c for c in df.columns if c not in ids])
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in metrics])
    return typed.unpivot(list(ids), metrics, "metric", "value").filter(F.col("value").isNotNull())
