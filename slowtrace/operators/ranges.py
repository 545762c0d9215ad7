"""Integer ranges as rows, and monotone cells that cut a group into bounded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.timebase import floor_div

_CHUNK = 4096


def explode_range(df: DataFrame, first: Column, last: Column, out: str, dealt: bool = False) -> DataFrame:
    """One row per integer in ``[first, last]``; rows with an empty range vanish.

    Two steps, so that no row ever carries an array longer than a chunk: a month of
    seconds would otherwise be a 20 MB array. ``sequence`` counts down on an inverted
    range, hence the filter. ``dealt``: few rows have long ranges, so chunks are dealt to
    all tasks before they are exploded.
    """
    ranged = df.withColumns({"__first": first.cast("bigint"), "__last": last.cast("bigint")})
    ranged = ranged.filter(F.col("__first") <= F.col("__last"))
    chunked = ranged.withColumn(
        "__chunk",
        F.explode(F.sequence(floor_div(F.col("__first"), _CHUNK), floor_div(F.col("__last"), _CHUNK))),
    )
    if dealt:
        chunked = chunked.repartition("__chunk")
    start = F.col("__chunk") * F.lit(_CHUNK).cast("bigint")
    stop = start + F.lit(_CHUNK - 1).cast("bigint")
    return chunked.withColumn(
        out,
        F.explode(F.sequence(F.greatest("__first", start), F.least(F.col("__last"), stop))),
    ).drop("__first", "__last", "__chunk")


def time_cell(col: Column, width: int) -> Column:
    """Cell of an integer time: rows of one key are cut every ``width`` units."""
    return floor_div(col, width)


def value_cell(col: Column, resolution: int = 4096) -> Column:
    """Cell of a number that never decreases as the number grows.

    Log-linear with ``resolution`` cells per octave, so a cell holds values that agree
    to a part in ``resolution`` and any spread of magnitudes is cut evenly.
    """
    value = col.cast("double")
    edge = 1 << 60
    magnitude = F.floor(F.log2(F.abs(value)) * F.lit(float(resolution))) + F.lit(1100 * resolution)
    infinite = F.abs(value) == F.lit(float("inf"))
    return (
        F.when(value.isNull(), F.lit(None).cast("bigint"))
        .when(F.isnan(value), F.lit(2 * edge))
        .when(infinite, F.when(value > 0, F.lit(edge)).otherwise(F.lit(-edge)))
        .when(value == 0, F.lit(0).cast("bigint"))
        .when(value > 0, magnitude)
        .otherwise(-magnitude)
    )
