"""Response-time quantiles and throughput per tick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowtrace.functions.scalars import slo_flag
from slowtrace.functions.timebase import epoch_us, floor_div
from slowtrace.operators.intervals import active_at_ticks, dense_ticks
from slowtrace.operators.ranges import explode_range
from slowtrace.operators.ranking import quantile


def load_response_times(df: DataFrame, end_ts: str = "end_ts", duration_ms: str = "duration_ms") -> DataFrame:
    """``end_ts`` + ``duration_ms`` → ``start_epoch_s``, ``end_epoch_s``, ``duration_s``.

    The start is truncated toward zero after the subtraction.
    """
    end_s = floor_div(epoch_us(F.col(end_ts)), 1_000_000)
    seconds = F.col(duration_ms) / F.lit(1000.0)
    return (
        df.withColumn("end_epoch_s", end_s)
        .withColumn("duration_s", seconds)
        .withColumn("start_epoch_s", (F.col("end_epoch_s") - F.col("duration_s")).cast("bigint"))
    )


def response_percentiles(
    requests: DataFrame,
    q: float = 0.9,
    factor: int = 1,
    slo: float | None = None,
    start: str = "start",
    end: str = "end",
    duration: str = "duration",
    inclusive_end: bool = False,
    dense: bool = True,
) -> DataFrame:
    """Exact interpolated quantile of the requests in flight at each tick.

    Every tick between the first start and the last end is there; one without requests
    has no value and never violates the objective. With ``inclusive_end`` a request is in
    flight up to and including its end (the per-second variant).
    """
    stop = "within" if inclusive_end else "beyond"
    active = active_at_ticks(requests, factor, start, end, inclusive_end, stop)
    values = quantile(active, ["tick"], duration, q, "percentile_value")
    if dense:
        values = dense_ticks(requests, factor, start, end, stop).join(values, "tick", "left")
    result = values.select(F.col("tick").alias("epoch_s"), "percentile_value")
    if slo is None:
        return result
    return result.withColumn("slo_violation", slo_flag(F.col("percentile_value"), slo))


def hdr_value(value: Column, significant_bits: int = 8) -> Column:
    """The highest value that shares a histogram slot with ``value``.

    Slots hold two significant decimal digits: 256 exact values, then 128 slots per
    octave. Integer arithmetic only, so slot edges are exact.
    """
    whole = value.cast("bigint")
    shift = F.greatest(F.length(F.bin(whole)) - F.lit(significant_bits), F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    return whole - F.pmod(whole, width) + width - F.lit(1).cast("bigint")


def response_percentiles_hdr(
    requests: DataFrame,
    q: float = 0.95,
    factor: int = 1,
    start: str = "start",
    end: str = "end",
    duration: str = "duration",
    dense: bool = True,
    dedupe_start: bool = False,
) -> DataFrame:
    """Histogram quantile (two significant digits) per tick; an empty tick has 0.

    A tick is reduced to one row per slot with map-side aggregation, at most a few
    thousand rows however many requests it has, before its slots are ordered.
    """
    active = active_at_ticks(requests, factor, start, end, dedupe_start=dedupe_start)
    slots = active.groupBy("tick", hdr_value(F.col(duration)).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tick = Window.partitionBy("tick")
    placed = slots.select(
        "tick",
        "slot",
        F.sum("n").over(tick.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.sum("n").over(tick).alias("total"),
    )
    need = F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1))
    values = placed.filter(F.col("upto") >= need).groupBy("tick").agg(F.min("slot").alias("value"))
    if dense:
        values = dense_ticks(requests, factor, start, end, "within").join(values, "tick", "left")
    return values.select(
        floor_div(F.col("tick"), factor).alias("tick"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
    )


def _histograms(slots: DataFrame, keys: list[str]) -> DataFrame:
    """(slot, n) rows of each group as one array in slot order; there are at most a few thousand slots."""
    return slots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("slots"), F.sum("n").alias("total"))


def tick_histograms(requests: DataFrame, width: int, keys: Sequence[str] = (), end: str = "end", duration: str = "duration") -> DataFrame:
    """``keys, tick, slots, total``: the durations of requests that ended in each tick, as a histogram to be stored.

    A request counts in one tick, so stored histograms can be added over any wider interval. Requests without a duration
    or an end are left out; a negative duration fails the job, as slots start at 0.
    """
    value = F.col(duration)
    value = F.when(value < 0, F.raise_error(F.lit("negative duration")).cast("bigint")).otherwise(hdr_value(value))
    placed = requests.filter(F.col(duration).isNotNull() & F.col(end).isNotNull()).select(
        *keys, (floor_div(F.col(end), width) * F.lit(width).cast("bigint")).alias("tick"), value.alias("slot"))
    return _histograms(placed.groupBy(*keys, "tick", "slot").agg(F.count(F.lit(1)).alias("n")), [*keys, "tick"])


def merged_histograms(histograms: DataFrame, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Stored histograms added over ticks of ``width``, a multiple of theirs; the log is not needed."""
    wide = (floor_div(F.col("tick"), width) * F.lit(width).cast("bigint")).alias("tick")
    slots = histograms.select(*keys, wide, F.inline("slots"))
    return _histograms(slots.groupBy(*keys, "tick", "slot").agg(F.sum("n").alias("n")), [*keys, "tick"])


def histogram_quantiles(histograms: DataFrame, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, tick, total`` and per quantile, named ``p<percent>``, the smallest slot that so many requests do not pass."""
    def at(q: float) -> Column:
        need = F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1))

        def step(found: Column, slot: Column) -> Column:
            upto = found["upto"] + slot["n"]
            hit = found["value"].isNull() & (upto >= need)
            return F.struct(upto.alias("upto"), F.when(hit, slot["slot"]).otherwise(found["value"]).alias("value"))

        nothing = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("value"))
        return F.aggregate("slots", nothing, step, lambda found: found["value"])

    return histograms.select(*keys, "tick", "total", *[at(q).alias(f"p{100 * q:g}".replace(".", "_")) for q in qs])


def throughput(
    requests: DataFrame, factor: int = 1, end: str = "end", half_open: bool = False, dense: bool = True
) -> DataFrame:
    """Requests that ended in ``[s, s + factor]`` for each tick ``s`` before the last end.

    Both borders count, so an end on a border is seen by two ticks; ``half_open`` counts
    it once. Each end yields its one or two ticks and is counted by a plain aggregation.
    """
    bounds = requests.agg(F.min(end).alias("lo"), F.max(end).alias("hi"))
    ends = requests.select(
        end, bounds.select("lo").scalar().alias("__origin"), bounds.select("hi").scalar().alias("__final")
    )
    origin, final = F.col("__origin"), F.col("__final")
    unit = F.lit(factor).cast("bigint")
    index = floor_div(F.col(end) - origin, factor)
    on_border = F.pmod(F.col(end) - origin, unit) == 0
    lower = index if half_open else F.when(on_border & (index > 0), index - F.lit(1)).otherwise(index)
    placed = explode_range(ends, lower, index, "__tick")
    counts = (
        placed.withColumn("tick", origin + F.col("__tick") * unit)
        .filter(F.col("tick") < final)
        .groupBy("tick")
        .agg(F.count(F.lit(1)).alias("operations"))
    )
    if dense:
        counts = dense_ticks(requests, factor, end, end, "before").join(counts, "tick", "left")
    return counts.select(
        floor_div(F.col("tick"), factor).alias("tick"),
        F.coalesce("operations", F.lit(0).cast("bigint")).alias("operations"),
    )
