"""Column functions: identifiers, latency classes, scores and flags. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds (ns, inclusive) of latency classes 0..6; above is 7.
LATENCY_BOUNDS_NS = [1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000]

# Futex operation codes and flags of the Linux system call.
FUTEX_WAIT, FUTEX_WAKE, FUTEX_WAIT_BITSET, FUTEX_WAKE_BITSET = 0, 1, 9, 10
FUTEX_PRIVATE_FLAG, FUTEX_CLOCK_REALTIME = 128, 256

# The device number is major << 20 | minor, in 32 bits.
MAJOR_BITS, MINOR_BITS = 12, 20

# Fixed value: process flag of a kernel thread.
KTHREAD_FLAG = 0x00200000


def tgid_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def tid_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def split_tgid_pid(packed: Column) -> list[Column]:
    """A packed thread id → ``pid`` (thread group) and ``tid``."""
    return [tgid_of(packed).alias("pid"), tid_of(packed).alias("tid")]


def encode_device(major: Column, minor: Column) -> Column:
    """A kernel device number; what its fields cannot hold goes on above bit 32: 12 bits of the minor, 20 of the major.

    Numbers of more than 32 bits, and negative ones, fail the job.
    """
    major, minor = major.cast("bigint"), minor.cast("bigint")
    low = F.shiftleft(_bits(major, 0, MAJOR_BITS), MINOR_BITS).bitwiseOR(_bits(minor, 0, MINOR_BITS))
    high = F.shiftleft(_bits(major, MAJOR_BITS, 20), MAJOR_BITS).bitwiseOR(_bits(minor, MINOR_BITS, 12))
    text = F.concat(F.lit("no device number: "), major.cast("string"), F.lit(":"), minor.cast("string"))
    fits = F.shiftright(major.bitwiseOR(minor), 32) == 0
    return F.when(~fits, F.raise_error(text).cast("bigint")).otherwise(F.shiftleft(high, 32).bitwiseOR(low))


def device_major(device: Column) -> Column:
    device = device.cast("bigint")
    return F.shiftleft(_bits(device, 44, 20), MAJOR_BITS).bitwiseOR(_bits(device, MINOR_BITS, MAJOR_BITS))


def device_minor(device: Column) -> Column:
    device = device.cast("bigint")
    return F.shiftleft(_bits(device, 32, 12), MINOR_BITS).bitwiseOR(_bits(device, 0, MINOR_BITS))


def _bits(value: Column, low: int, number: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << number) - 1).cast("bigint"))


def device_label(device: Column) -> Column:
    return F.concat_ws(":", device_major(device).cast("string"), device_minor(device).cast("string"))


def log10_bucket(ns: Column) -> Column:
    """Latency class 0..7 by powers of ten. Compares integers: log10 is off at the edges."""
    cases = [F.when(ns <= bound, F.lit(i)) for i, bound in enumerate(LATENCY_BOUNDS_NS)]
    return F.coalesce(*cases, F.when(ns.isNotNull(), F.lit(len(LATENCY_BOUNDS_NS))))


def histogram_columns(bucket: str) -> list[Column]:
    """Aggregates ``hist0..hist7`` over a column of latency classes.

    Rows without a class are not counted; a group of only such rows has NULL.
    """
    return [
        F.expr(f"sum(CASE WHEN {bucket} = {i} THEN 1L WHEN {bucket} IS NOT NULL THEN 0L END) AS hist{i}")
        for i in range(8)
    ]


def normalize_futex_op(op: Column) -> Column:
    """Clear the modifier flags; WAIT/WAIT_BITSET → 0, WAKE/WAKE_BITSET → 1, other → NULL."""
    base = op.bitwiseAND(F.lit(~(FUTEX_PRIVATE_FLAG | FUTEX_CLOCK_REALTIME)))
    return F.when(base.isin(FUTEX_WAIT, FUTEX_WAIT_BITSET), F.lit(FUTEX_WAIT)).when(
        base.isin(FUTEX_WAKE, FUTEX_WAKE_BITSET), F.lit(FUTEX_WAKE)
    )


def saturation(rate: Column, alpha: float = 100.0, beta: float = -0.9) -> Column:
    """Logistic score of a per-second rate; with the defaults it turns on at 0.9."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-alpha) * (rate + F.lit(beta))))


def cap(col: Column, limit: float = 1.0) -> Column:
    """``min(col, limit)``; a missing value stays missing."""
    return F.when(col.isNotNull(), F.least(col, F.lit(limit)))


def ns_to_ms(col: Column) -> Column:
    return col / F.lit(1_000_000.0)


def us_to_ms(col: Column) -> Column:
    return col / F.lit(1_000.0)


def slo_flag(value: Column, threshold: float) -> Column:
    """1.0 where the value breaks the objective, else 0.0; no value counts as no violation."""
    return F.coalesce(value > F.lit(threshold), F.lit(False)).cast("double")


def clip_epoch(df: DataFrame, start, end, col: str = "epoch_s") -> DataFrame:
    """Rows strictly inside ``(start, end)``."""
    return df.filter((F.col(col) > F.lit(start)) & (F.col(col) < F.lit(end)))


def relative_epoch(df: DataFrame, col: str = "epoch_s", out: str = "relative_epoch_s") -> DataFrame:
    """Adds ``col - min(col)``. The minimum is a scalar subquery, not a join or a window."""
    origin = df.agg(F.min(col).alias("origin")).scalar()
    return df.withColumn(out, F.col(col) - origin)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
