"""Start/end pairing, slicing by time bucket, and interval joins without theta joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.timebase import ceil_div, floor_div
from slowtrace.operators.carry import with_balanced_cells, with_neighbours
from slowtrace.operators.ranges import explode_range, time_cell

NS_PER_HOUR = 3_600_000_000_000


def pair_events(
    events: DataFrame,
    keys: Sequence[str],
    start_kind: str,
    end_kind: str,
    kind: str = "kind",
    ts: str = "ts",
    order: Sequence[str] | None = None,
    payload: Sequence[str] = (),
    cell_width: int | None = NS_PER_HOUR,
    cell_rows: int | None = None,
) -> DataFrame:
    """Completed operations: ``keys, start, end`` + the start row's ``payload``.

    An end belongs to the event right before it when that is a start; a newer start
    replaces an unfinished one, and an end without an open start is ignored. A key is cut every ``cell_width`` of time or,
    with ``cell_rows``, into stretches of about so many rows.
    """
    order = list(order or [ts])
    wanted = events.filter(F.col(kind).isin(start_kind, end_kind))
    take = {"__prev_kind": kind, "start": ts, **{f"__from_{c}": c for c in payload}}
    cell = None if cell_width is None else time_cell(F.col(ts), cell_width)
    wanted = wanted.select(*dict.fromkeys([*keys, kind, *order, ts, *payload]))
    if cell_rows is not None:
        wanted, cell = with_balanced_cells(wanted, keys, ts, cell_rows), F.col("__balanced")
    seen = with_neighbours(wanted, keys, order, cell, previous=take)
    return seen.filter((F.col(kind) == end_kind) & (F.col("__prev_kind") == start_kind)).select(
        *keys, "start", F.col(ts).alias("end"), *[F.col(f"__from_{c}").alias(c) for c in payload]
    )


def open_events(
    events: DataFrame,
    keys: Sequence[str],
    start_kind: str,
    end_kind: str,
    kind: str = "kind",
    ts: str = "ts",
    order: Sequence[str] | None = None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Operations still open at the end of the log: keys whose last event is a start."""
    order = list(order or [ts])
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    last = events.filter(F.col(kind).isin(start_kind, end_kind)).groupBy(*keys).agg(
        F.max_by(kind, key).alias("__kind"),
        F.max_by(ts, key).alias("start"),
        *[F.max_by(c, key).alias(c) for c in payload],
    )
    return last.filter(F.col("__kind") == start_kind).drop("__kind")


def inverted_intervals(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose end comes before their start. The operators below refuse them; set them aside first."""
    return df.filter(F.col(end) < F.col(start))


def without_inverted(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The other rows, open ones included. An anti join would not do: the check may be pushed below it."""
    return df.filter(~F.coalesce(F.col(end) < F.col(start), F.lit(False)))


def upright(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``df``; a row whose end comes before its start fails the job instead of vanishing."""
    text = F.concat(F.lit("interval ends before it starts: "), F.col(start).cast("string"), F.lit(" > "), F.col(end).cast("string"))
    return df.filter(F.when(F.col(end) < F.col(start), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def split_by_bucket(
    df: DataFrame, bucket: int, start: str = "start", end: str = "end", touch_end: bool = False, clipped: bool = False
) -> DataFrame:
    """One row per bucket an interval ``[start, end)`` covers.

    Adds ``bucket`` (its start), ``slice_start``, ``slice_end`` and ``slice``; the slices
    of an interval add up to ``end - start``, and an empty one has none. With ``touch_end`` the bucket that holds
    ``end`` itself is always there, with slice 0 when ``end`` is on its boundary. An end
    before the start fails the job, unless ends were ``clipped``: then nothing is left of it.
    """
    reach = F.col(end) if touch_end else F.when(F.col(end) > F.col(start), F.col(end) - F.lit(1))
    sliced = explode_range(
        df.filter(F.col(end) >= F.col(start)) if clipped else upright(df, start, end),
        floor_div(F.col(start), bucket),
        floor_div(reach, bucket),
        "__index",
    )
    unit = F.lit(bucket).cast("bigint")
    return (
        sliced.withColumn("bucket", F.col("__index") * unit)
        .withColumn("slice_start", F.greatest(F.col(start), F.col("bucket")))
        .withColumn("slice_end", F.least(F.col(end), F.col("bucket") + unit))
        .withColumn("slice", F.col("slice_end") - F.col("slice_start"))
        .drop("__index")
    )


def covering_nodes(first: str, last: str) -> Column:
    """The fewest dyadic nodes (level, node) that cover the cells from ``first`` to ``last``, at most two per level.

    Node ``n`` of level ``k`` holds the cells ``n * 2**k`` to ``(n + 1) * 2**k - 1``. On each level the nodes left over at
    either side, which no node of the next level can take, are those with an odd border.
    """
    left, right = f"(-shiftright(-{first}, k))", f"shiftright({last} + 1, k)"
    edges = ", ".join(
        f"named_struct('level', k, 'node', IF({left} < {right} AND {border} % 2 <> 0, {node}, NULL))"
        for border, node in ((left, left), (right, f"{right} - 1"))
    )
    levels = f"sequence(0, length(bin({last} - {first} + 1)) - 1)"
    return F.expr(f"filter(flatten(transform({levels}, k -> array({edges}))), n -> n.node IS NOT NULL)")


def _met_by_points(df: DataFrame, other: DataFrame, bounds: tuple[str, str], other_bounds: tuple[str, str], width: int, role: int) -> DataFrame:
    """Rows of ``df`` once per node that covers them (``__role`` = ``role``) and once per node that may hold their start."""
    def cells(side: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(end) - F.lit(1))
        return side.withColumns({"__first": floor_div(F.col(start), width), "__last": floor_div(last, width)})

    def node_role(value: int) -> Column:
        return F.lit(value).alias("role")

    longest = cells(upright(other, *other_bounds), *other_bounds).agg(F.max(F.expr("length(bin(__last - __first + 1)) - 1")).alias("top"))
    spread = cells(upright(df, *bounds), *bounds).withColumn("__top", F.coalesce(longest.scalar(), F.lit(0)))
    cover = F.transform(covering_nodes("__first", "__last"), lambda n: F.struct(node_role(role), n["level"].alias("level"), n["node"].alias("node")))
    above = F.transform(F.sequence(F.lit(0), F.col("__top")), lambda k: F.struct(
        node_role(1 - role), k.alias("level"), F.call_function("shiftright", F.col("__first"), k).alias("node")))
    met = spread.filter(F.col("__first").isNotNull() & F.col("__last").isNotNull()).withColumn("__at", F.explode(F.concat(cover, above)))
    return met.withColumns({"__role": F.col("__at.role"), "__level": F.col("__at.level"), "__node": F.col("__at.node")}).drop(
        "__at", "__first", "__last", "__top")


def intersect_intervals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cell_width: int,
    left_bounds: tuple[str, str] = ("a_start", "a_end"),
    right_bounds: tuple[str, str] = ("b_start", "b_end"),
) -> DataFrame:
    """Every overlapping pair of intervals with equal keys, with ``start`` and ``end`` of the overlap.

    Of two intervals that overlap one starts inside the other. So each interval is cut into the O(log n) dyadic nodes of time
    cells that cover it, each start looks up the nodes above its cell, and both meet by an equi join: a pair once,
    however many cells it shares, and nobody else but neighbours in the cell of a border. Levels go up to the longest
    interval of the other side; a hot key is split over its nodes.
    """
    ls, le = left_bounds
    rs, re = right_bounds
    one = _met_by_points(left, right, left_bounds, right_bounds, cell_width, 0)
    two = _met_by_points(right, left, right_bounds, left_bounds, cell_width, 1)
    inside = F.when(F.col("__role") == 0, F.col(rs) >= F.col(ls)).otherwise(F.col(ls) > F.col(rs))
    return (
        one.join(two, [*keys, "__role", "__level", "__node"])
        .filter((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & inside)
        .withColumn("start", F.greatest(ls, rs))
        .withColumn("end", F.least(le, re))
        .drop("__role", "__level", "__node")
    )


def _extent(requests: DataFrame, first: str, last: str) -> tuple[Column, Column]:
    bounds = requests.agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
    return bounds.select("lo").scalar(), bounds.select("hi").scalar()


def active_at_ticks(
    requests: DataFrame,
    factor: int = 1,
    start: str = "start",
    end: str = "end",
    inclusive_end: bool = False,
    last_tick: str = "within",
    dedupe_start: bool = False,
) -> DataFrame:
    """One row per (request, tick) where the request was in flight; adds ``tick``.

    Ticks run ``first start + n·factor``. A request counts at tick ``c`` when it started
    by ``c`` and ended after ``c − factor`` (with ``inclusive_end``: at or after ``c``).
    ``last_tick`` says where ticks stop: ``within`` the last end, or one step ``beyond``
    it. Every request yields its own ticks, so there is no tick × request join.

    All requests count. ``dedupe_start`` keeps one per distinct start, as a log keyed by
    start time would.
    """
    if dedupe_start:
        rest = [c for c in requests.columns if c != start]
        requests = requests.groupBy(start).agg(F.max(F.struct(end, *[c for c in rest if c != end])).alias("r"))
        requests = requests.select(start, "r.*")
    requests = upright(requests, start, end)
    low, high = _extent(requests, start, end)
    # as columns of their own: each bound is one subquery however often it is used below
    requests = requests.withColumns({"__origin": low, "__final": high})
    origin, final = F.col("__origin"), F.col("__final")
    unit = F.lit(factor).cast("bigint")
    lower = ceil_div(F.col(start) - origin, factor)
    if inclusive_end:
        upper = floor_div(F.col(end) - origin, factor)
    else:
        upper = ceil_div(F.col(end) - origin, factor)
    limit = floor_div(final - origin, factor) if last_tick == "within" else ceil_div(final - origin, factor)
    spread = explode_range(requests, lower, F.least(upper, limit), "__tick")
    return spread.withColumn("tick", origin + F.col("__tick") * unit).drop("__tick", "__origin", "__final")


def dense_ticks(
    df: DataFrame, factor: int, first: str, last: str, stop: str = "within"
) -> DataFrame:
    """All ticks ``min(first) + n·factor``: up to ``max(last)`` (``within``), strictly before it
    (``before``) or to one step past it (``beyond``)."""
    bounds = df.agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
    span = F.col("hi") - F.col("lo")
    limit = {
        "within": floor_div(span, factor),
        "before": ceil_div(span, factor) - F.lit(1),
        "beyond": ceil_div(span, factor),
    }[stop]
    ticks = explode_range(bounds, F.lit(0), limit, "__tick", dealt=True)
    return ticks.select((F.col("lo") + F.col("__tick") * F.lit(factor).cast("bigint")).alias("tick"))
