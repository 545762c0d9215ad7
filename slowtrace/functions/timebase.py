"""Integer time arithmetic: epochs, buckets and the boot clock."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

NS_PER_S = 1_000_000_000
_ORIGIN = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_UTC_NAMES = {"UTC", "Etc/UTC", "Z", "GMT", "+00:00", "Etc/GMT"}


def floor_div(col: Column, width: int) -> Column:
    """Exact integer floor division; a detour through doubles would lose nanoseconds."""
    unit = F.lit(width).cast("bigint")
    return F.call_function("div", col - F.pmod(col, unit), unit)


def ceil_div(col: Column, width: int) -> Column:
    return -floor_div(-col, width)


def floor_to(col: Column, width: int) -> Column:
    return col - F.pmod(col, F.lit(width).cast("bigint"))


def epoch_us(col: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session time zone."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return F.unix_micros(col.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", F.expr(_ORIGIN), col)


def boot_to_epoch(boot_ns: Column, offset_ns: int | Column) -> Column:
    """Nanoseconds since boot → nanoseconds since 1970."""
    offset = offset_ns if isinstance(offset_ns, Column) else F.lit(offset_ns)
    return boot_ns + offset.cast("bigint")


def boot_second_to_epoch(boot_ns: Column, offset_ns: int | Column) -> Column:
    """The epoch ns of the second an event falls in, floored on the *boot* clock.

    All rows of a run share the sub-second phase of the offset, so equal seconds stay
    equal; flooring after the shift would split them.
    """
    return boot_to_epoch(floor_to(boot_ns, NS_PER_S), offset_ns)


def ns_to_timestamp(epoch_ns: Column) -> Column:
    """Epoch ns → TIMESTAMP_NTZ at microsecond precision."""
    return F.timestamp_add("MICROSECOND", floor_div(epoch_ns, 1000), F.expr(_ORIGIN))
