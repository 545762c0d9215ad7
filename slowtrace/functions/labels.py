"""Series names: building, taking apart and selecting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The dimensions that together name a series, in order.
SERIES_DIMENSIONS = ["scope", "pid", "tid", "comm", "metric_class", "ipc_type", "resource", "metric"]


def series_id() -> Column:
    """``scope/pid/tid/class/ipc/resource/metric``; missing parts are left out.

    The older layout has a command name in the place of the pid.
    """
    owner = F.coalesce(F.col("pid").cast("string"), F.col("comm"))
    parts = ["scope", owner, F.col("tid").cast("string"), "metric_class", "ipc_type", "resource", "metric"]
    return F.concat_ws("/", *parts)


def series_label(col: Column, pattern: str, template: str | None = None) -> Column:
    """A short label out of a series name: group 1, or a template over all groups."""
    if template is None:
        found = F.regexp_extract(col, pattern, 1)
        return F.when(found != "", found)
    return F.regexp_replace(col, pattern, template)


def select_series(
    points: DataFrame, include: str | None = None, exclude: str | None = None, col: str = "series_id"
) -> DataFrame:
    """Keep series whose name matches ``include`` and not ``exclude`` (Java regex, look-around works)."""
    kept = points
    if include is not None:
        kept = kept.filter(F.col(col).rlike(include))
    if exclude is not None:
        kept = kept.filter(~F.col(col).rlike(exclude))
    return kept
