"""Exact ranks and quantiles of groups of any size.

A group is first reduced to ``(value, how many)`` rows with map-side aggregation, so
ties collapse. The position of every value then is a running sum along the value,
carried over value cells: no task sorts or holds a whole group, unlike the built-in
exact percentile, whose buffer keeps all distinct values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowtrace.operators.carry import with_running_sum
from slowtrace.operators.keys import join_groups
from slowtrace.operators.ranges import value_cell
from slowtrace.session import settle


def value_positions(df: DataFrame, keys: Sequence[str], value: str, resolution: int = 4096) -> DataFrame:
    """``keys, value, n, below, total``: n equal values come after ``below`` smaller ones."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_running_sum(
        counts, keys, [value], {"below": "n"}, value_cell(F.col(value), resolution),
        inclusive=False, totals={"total": "n"},
    )


def avg_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", resolution: int = 4096
) -> DataFrame:
    """Adds the 1-based rank of ``value`` in its group; ties share their mean rank."""
    ranks = value_positions(df, keys, value, resolution).select(
        *keys, value, (F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias(out)
    )
    return join_groups(df, ranks, [*keys, value], "left")


_COARSE = 64


def quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    out: str = "quantile",
    kind: str = "linear",
) -> DataFrame:
    """Exact quantile per group.

    ``linear`` interpolates between the two nearest values, ``disc`` returns the first
    value whose cumulative share reaches ``q``.

    First, rows are counted per (group, value cell) with map-side aggregation; that says
    which one or two cells of a group hold the wanted positions. These few rows are
    written as a table of known size, so that the second pass over the data is a filter,
    not a shuffle. Only values of the wanted cells are then put in order, themselves cut
    into finer cells.
    """
    if kind not in ("linear", "disc"):
        raise ValueError(f"unknown quantile kind: {kind}")
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    cells = rows.withColumn("__part", value_cell(F.col(value), _COARSE))
    counts = cells.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *keys, "__part", "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")).alias("__below"),
        F.sum("__n").over(group).alias("__total"),
    )
    # 0-based positions of the wanted values
    if kind == "disc":
        exact = (F.greatest(F.ceil(F.lit(q) * F.col("__total")), F.lit(1)) - F.lit(1)).cast("double")
    else:
        exact = F.lit(q) * (F.col("__total") - F.lit(1))
    low, high = F.floor("__exact"), F.ceil("__exact")
    wanted = placed.withColumn("__exact", exact).filter(
        (F.col("__below") <= high) & (low < F.col("__below") + F.col("__n"))
    )
    wanted = settle(wanted.select(*keys, "__part", "__below", "__exact"))
    inside = join_groups(cells, wanted, [*keys, "__part"])
    ordered = value_positions(inside, [*keys, "__part", "__below", "__exact"], value, _COARSE * 4096)
    first = F.col("__below") + F.col("below")

    def at(index: Column) -> Column:
        holds = (first <= index) & (index < first + F.col("n"))
        return F.max(F.when(holds, F.col(value).cast("double") if kind == "linear" else F.col(value)))

    picked = ordered.groupBy(*keys).agg(
        at(low).alias("__low"), at(high).alias("__high"), F.max(F.col("__exact") - low).alias("__rest")
    )
    if kind == "disc":
        return picked.select(*keys, F.col("__low").alias(out))
    step = (F.col("__high") - F.col("__low")) * F.col("__rest")
    return picked.select(*keys, (F.col("__low") + step).alias(out))
