"""Which series move with the target, which are active, and how values spread over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowtrace.operators.keys import join_groups
from slowtrace.operators.ranking import avg_rank, quantile

SERIES = ("series_id",)


def _pearson(x: str, y: str) -> Column:
    """Correlation as a partial aggregate; NULL (not an error) for a constant series."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate(
    points: DataFrame,
    target: DataFrame,
    method: str = "pearson",
    min_abs: float | None = None,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    target_value: str = "target",
    on: Sequence[str] = ("epoch_s",),
) -> DataFrame:
    """Correlation of every series with the target, all series in one job.

    Pairs with a missing (NULL or NaN) side are dropped per series, before ranking. Constant series
    have no correlation and give no row. Sort with ``top_k`` or ``orderBy``.
    """
    pairs = points.select(*keys, *on, F.col(value).alias("__x")).join(
        target.select(*on, F.col(target_value).alias("__y")), list(on)
    ).filter("NOT isnan(__x) AND NOT isnan(__y) AND __x IS NOT NULL AND __y IS NOT NULL")
    x, y = "__x", "__y"
    if method == "spearman":
        pairs = avg_rank(avg_rank(pairs, keys, "__x", "__rx"), keys, "__y", "__ry")
        x, y = "__rx", "__ry"
    elif method != "pearson":
        raise ValueError(f"unknown correlation method: {method}")
    scores = pairs.groupBy(*keys).agg(_pearson(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))
    scores = scores.filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    if min_abs is not None:
        scores = scores.filter(F.abs("corr") > F.lit(min_abs))
    return scores


def rank_by_strength(scores: DataFrame, absolute: bool = False) -> DataFrame:
    """Strongest first; ``absolute`` ignores the sign."""
    by = F.abs("corr") if absolute else F.col("corr")
    return scores.orderBy(by.desc(), *[c for c in scores.columns if c not in ("corr", "n")])


def top_k(df: DataFrame, by: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + k`` of a total order; ``by`` must break all ties."""
    ordered = df.orderBy(*by)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def series_stat(points: DataFrame, stat: str, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """``max``, ``mean`` or exact ``median`` of every series, as column ``stat``."""
    if stat == "median":
        return quantile(points, keys, value, 0.5, "stat")
    aggregate = {"max": F.max, "mean": F.avg}[stat]
    return points.groupBy(*keys).agg(aggregate(value).alias("stat"))


def active_series(
    points: DataFrame, stat: str, threshold: float, keys: Sequence[str] = SERIES, value: str = "value"
) -> DataFrame:
    """All points of the series whose statistic reaches the threshold."""
    chosen = series_stat(points, stat, keys, value).filter(F.col("stat") >= F.lit(threshold))
    return join_groups(points, chosen.select(*keys), keys, "left_semi")


def histogram2d(
    points: DataFrame,
    x_bins: int | None = None,
    y_bins: int = 10,
    x: str = "epoch_s",
    y: str = "value",
    within: int | None = None,
    origin: int | None = None,
) -> DataFrame:
    """Relative frequency of values per time bin; the frequencies of a time bin add up to 1.

    Only positive values count, and with ``within`` only those before ``origin + within``.
    Bins are equally wide over [min, max], the last one closed; the default is one time
    bin per second. Empty cells give no row.
    """
    rows = points.filter(F.col(y) > 0)
    if within is not None:
        start = F.lit(origin) if origin is not None else points.agg(F.min(x).alias("o")).scalar()
        rows = rows.filter(F.col(x) < start + F.lit(within))
    bounds = rows.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )
    rows = rows.select(x, y, *[bounds.select(c).scalar().alias(c) for c in ("x0", "x1", "y0", "y1")])
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    count = F.greatest(x1 - x0, F.lit(1)) if x_bins is None else F.lit(x_bins)

    def bin_of(col: str, low: Column, high: Column, bins: Column) -> Column:
        place = F.coalesce(F.try_divide((F.col(col) - low) * bins, (high - low).cast("double")), F.lit(0.0))
        return F.least(F.floor(place), bins - F.lit(1)).cast("bigint")

    cells = (
        rows.select(bin_of(x, x0, x1, count).alias("x_bin"), bin_of(y, y0, y1, F.lit(y_bins)).alias("y_bin"))
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # at most y_bins rows per time bin are left here
    total = F.sum("n").over(Window.partitionBy("x_bin"))
    return cells.withColumn("frequency", F.col("n") / total)
