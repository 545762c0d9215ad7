"""Ordered windows that never hold one key in one task.

``lag``, running totals and "last known value" normally partition by key, so a key
with a third of all rows ends up in one task. Here a key is cut into cells along its
order (an hour of time, a slice of the value range). The window runs inside
``(key, cell)``; one summary row per cell, built with map-side aggregation, is chained
over the cells of the key and joined back on the same ``(key, cell)`` partitioning.
The big side is shuffled once, and no task sees more than one cell of a hot key.

Rows of one key must follow the cells: the cell may not decrease along the order.
The parts of a key travel as one struct: a join on ``=`` then pairs NULL with NULL, as the
plain window does, and stays on the partitioning of the window.
``cell=None`` means the groups are known to be small and asks for the plain window.

A cell of fixed width does not know where rows crowd. :func:`with_balanced_cells` takes its borders from the data: about so
many rows to a cell, whatever the key and however bursty it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowtrace.session import settle

_CELL = "__cell"
_KEY = "__key"
_HERE, _OVER = "__here_", "__over_"


def _ordering(order: Sequence[str], following: bool) -> list[Column]:
    return [F.col(c).desc() if following else F.col(c).asc() for c in order]


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _edge(source: Column, order: Sequence[str], following: bool) -> Column:
    pick = F.min_by if following else F.max_by
    return pick(source, _order_key(order))


def _cut(df: DataFrame, keys: Sequence[str], cell: Column, used: Iterable[str]) -> DataFrame:
    """``df`` with its cell, and with ``keys`` moved into one struct that is never NULL itself.

    Keys that are ``used`` as plain columns too stay beside it.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    moved = set(keys).difference(used)
    return df.select("*", cell.alias(_CELL), key.alias(_KEY)).drop(*moved)


def _joined(inside: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = inside.join(carry, [_KEY, _CELL], "left")
    moved = [k for k in keys if k not in joined.columns]
    return joined.select("*", *[F.col(_KEY).getField(k).alias(k) for k in moved])


_CELLS = 1024        # cells that a key is cut into at most
_SKETCH_SIZE = 8192  # of a quantile sketch: its rank error is below a cell of the most finely cut key


def with_balanced_cells(df: DataFrame, keys: Sequence[str], ts: str, rows: int, out: str = "__balanced") -> DataFrame:
    """``df`` with ``out``: which stretch of integer ``ts`` a row is in, where a stretch of a key holds about ``rows`` rows.

    Quantile sketches are filled on the map side and merged per key; only keys with more than ``rows`` rows keep their
    borders, a small settled table that is broadcast by its measured size. A key is cut into 1,024 stretches at most.
    Rows with equal ``ts`` stay together, rows without one are in the first stretch; other keys have one, number 0.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    sketched = df.groupBy(key.alias(_KEY)).agg(
        F.kll_sketch_agg_bigint(F.col(ts).cast("bigint"), _SKETCH_SIZE).alias("sketch"), F.count(ts).alias("n")
    ).filter(F.col("n") > rows)
    ranks = F.array(*[F.lit(i / _CELLS) for i in range(1, _CELLS)])
    borders = settle(sketched.select(
        _KEY, F.kll_sketch_get_quantile_bigint("sketch", ranks).alias("__borders"),
        F.least(F.ceil(F.col("n") / F.lit(rows)), F.lit(_CELLS)).alias("__cells"),
    ))

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get("__borders", at + step - 1) <= F.col(ts), at + step).otherwise(at)

    # halving search for the number of borders that are not above ts
    steps = F.array(*[F.lit(_CELLS >> i) for i in range(1, _CELLS.bit_length())])
    passed = F.aggregate(steps, F.lit(0), further)
    cell = F.coalesce(F.floor(passed * F.col("__cells") / F.lit(_CELLS)), F.lit(0).cast("bigint"))
    return df.withColumn(_KEY, key).join(borders, [_KEY], "left").select(*df.columns, cell.alias(out))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column | None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds columns of the row before and the row after: new name → column taken."""
    previous, following = previous or {}, following or {}
    taken = {**previous, **following}

    def neighbour(window, source: Column | str, new: str) -> Column:
        step = F.lag if new in previous else F.lead
        return step(source).over(window)

    if cell is None:
        window = Window.partitionBy(*keys).orderBy(*_ordering(order, False))
        return df.select("*", *[neighbour(window, c, new).alias(new) for new, c in taken.items()])
    cut = _cut(df, keys, cell, {*order, *taken.values()})
    within = Window.partitionBy(_KEY, _CELL).orderBy(*_ordering(order, False))
    inside = cut.select(
        "*",
        *[neighbour(within, c, new).alias(_HERE + new) for new, c in taken.items()],
        F.lag(F.lit(True)).over(within).alias("__has_previous"),
        F.lead(F.lit(True)).over(within).alias("__has_following"),
    )
    edges = cut.groupBy(_KEY, _CELL).agg(
        *[_edge(F.col(c), order, False).alias(_OVER + new) for new, c in previous.items()],
        *[_edge(F.col(c), order, True).alias(_OVER + new) for new, c in following.items()],
    )
    across = Window.partitionBy(_KEY).orderBy(_CELL)
    carry = edges.select(
        _KEY, _CELL, *[neighbour(across, _OVER + new, new).alias(_OVER + new) for new in taken]
    )

    def chosen(new: str) -> Column:
        has = "__has_previous" if new in previous else "__has_following"
        return F.when(F.col(has), F.col(_HERE + new)).otherwise(F.col(_OVER + new)).alias(new)

    return _joined(inside, carry, keys).select(*df.columns, *[chosen(new) for new in taken])


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    take: Mapping[str, str],
    cell: Column | None,
    following: bool = False,
) -> DataFrame:
    """Adds the latest non-null value up to (or, ``following``, the next from) each row."""
    if cell is None:
        window = Window.partitionBy(*keys).orderBy(*_ordering(order, following)).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.select(
            "*", *[F.last(c, ignorenulls=True).over(window).alias(new) for new, c in take.items()]
        )
    cut = _cut(df, keys, cell, {*order, *take.values()})
    within = Window.partitionBy(_KEY, _CELL).orderBy(*_ordering(order, following)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = cut.select(
        "*", *[F.last(c, ignorenulls=True).over(within).alias(_HERE + new) for new, c in take.items()]
    )
    pick = F.min_by if following else F.max_by
    known = {
        new: pick(F.col(c), F.when(F.col(c).isNotNull(), _order_key(order))) for new, c in take.items()
    }
    edges = cut.groupBy(_KEY, _CELL).agg(*[agg.alias(_OVER + new) for new, agg in known.items()])
    across = Window.partitionBy(_KEY).orderBy(*_ordering([_CELL], following)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = edges.select(
        _KEY,
        _CELL,
        *[F.last(_OVER + new, ignorenulls=True).over(across).alias(_OVER + new) for new in take],
    )
    return _joined(inside, carry, keys).select(
        *df.columns, *[F.coalesce(_HERE + new, _OVER + new).alias(new) for new in take]
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    cell: Column | None,
    inclusive: bool = True,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds running sums (``sums``: new name → column), optionally with the key's ``totals``.

    Totals come out of the same per-cell summary, so they cost no further pass.
    """
    totals = totals or {}
    last = Window.currentRow if inclusive else -1
    if cell is None:
        plain = Window.partitionBy(*keys)
        window = plain.orderBy(*_ordering(order, False)).rowsBetween(Window.unboundedPreceding, last)
        return df.select(
            "*",
            *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(new) for new, c in sums.items()],
            *[F.sum(c).over(plain).alias(new) for new, c in totals.items()],
        )
    cut = _cut(df, keys, cell, {*order, *sums.values(), *totals.values()})
    within = Window.partitionBy(_KEY, _CELL).orderBy(*_ordering(order, False)).rowsBetween(
        Window.unboundedPreceding, last
    )
    inside = cut.select("*", *[F.sum(c).over(within).alias(_HERE + new) for new, c in sums.items()])
    edges = cut.groupBy(_KEY, _CELL).agg(
        *[F.sum(c).alias(_OVER + new) for new, c in sums.items()],
        *[F.sum(c).alias(_OVER + new) for new, c in totals.items()],
    )
    across = Window.partitionBy(_KEY)
    before = across.orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        _KEY,
        _CELL,
        *[F.sum(_OVER + new).over(before).alias(_OVER + new) for new in sums],
        *[F.sum(_OVER + new).over(across).alias(new) for new in totals],
    )
    return _joined(inside, carry, keys).select(
        *df.columns,
        *[
            (F.coalesce(_HERE + new, F.lit(0)) + F.coalesce(_OVER + new, F.lit(0))).alias(new)
            for new in sums
        ],
        *totals,
    )
