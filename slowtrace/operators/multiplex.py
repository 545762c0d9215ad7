"""Waits on poll/select/epoll sets: by thread, and by the files waited for.

Event kinds: ``poll_start``, ``poll_end``, ``poll_register`` (a file of the next poll
call of that thread), ``epoll_start``, ``epoll_end``, ``epoll_insert``, ``epoll_remove``.
Columns: ``kind, ts, seq, poll_id, pid, tid`` + the file columns. A plain poll set is
named by its thread, an epoll set by its kernel address.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowtrace.functions.timebase import NS_PER_S, floor_div, floor_to
from slowtrace.operators.accounting import call_times
from slowtrace.operators.carry import with_last_known, with_neighbours, with_running_sum
from slowtrace.operators.intervals import open_events, pair_events, split_by_bucket
from slowtrace.operators.keys import join_groups
from slowtrace.operators.ranges import explode_range, time_cell
from slowtrace.session import settle

FILE = ("fs_magic", "device_id", "inode_id")
_SET = ["is_epoll", "poll_id"]
_ORDER = ["ts", "seq"]
_COARSE = 4096


def _limit(events: DataFrame, horizon: int | None) -> Column:
    """Up to when open waits are accounted: the given time, or the last event of the log."""
    if horizon is not None:
        return F.lit(horizon).cast("bigint")
    return events.agg(F.max("ts").alias("last")).scalar()


def _packed_thread() -> Column:
    return F.shiftleft(F.col("pid").cast("bigint"), 32).bitwiseOR(F.col("tid").cast("bigint"))


def _thread_events(events: DataFrame) -> DataFrame:
    """Enter/leave events of both kinds of set under common names."""
    epoll = F.col("kind").startswith("epoll")
    owner = F.when(epoll, F.col("poll_id").cast("decimal(20,0)")).otherwise(_packed_thread().cast("decimal(20,0)"))
    return events.filter(
        F.col("kind").isin("poll_start", "poll_end", "epoll_start", "epoll_end")
    ).select(
        epoll.alias("is_epoll"), owner.alias("poll_id"), "pid", "tid", "ts", "seq",
        F.when(F.col("kind").endswith("start"), "enter").otherwise("leave").alias("kind"),
    )


def muxio_wait(
    events: DataFrame,
    bucket: int = NS_PER_S,
    horizon: int | None = None,
    cell_width: int | None = 3600 * NS_PER_S,
) -> DataFrame:
    """Time threads spend waiting in each poll/epoll set, split by bucket.

    The request counts in the bucket of completion. Waits without an end are accounted
    without being counted: one still open up to the ``horizon`` (the last event by
    default), one whose thread enters again up to the bucket of that second start.
    """
    keys = [*_SET, "pid", "tid"]
    cell = None if cell_width is None else time_cell(F.col("ts"), cell_width)
    moves = with_neighbours(
        _thread_events(events), keys, _ORDER, cell, following={"__kind": "kind", "__ts": "ts"}
    )
    waits = moves.filter(F.col("kind") == "enter").select(
        *keys,
        F.col("ts").alias("start"),
        F.when(F.col("__kind") == "leave", F.col("__ts")).alias("end"),
        F.coalesce(floor_to(F.col("__ts"), bucket), _limit(events, horizon)).alias("until"),
    )
    return call_times(waits, keys, bucket, F.col("until"))


def _poll_file_wait(
    events: DataFrame, bucket: int, horizon: int | None, cell_width: int | None, file: Sequence[str]
) -> DataFrame:
    """Files of plain poll calls: waited for from registration to the end of the call."""
    calls = events.filter(F.col("kind").isin("poll_start", "poll_end", "poll_register"))
    moves = calls.filter(F.col("kind") != "poll_register")
    keys = ["pid", "tid"]
    cell = None if cell_width is None else time_cell(F.col("ts"), cell_width)
    ends = with_neighbours(
        moves.select(*keys, "kind", *_ORDER), keys, _ORDER, cell, previous={"__kind": "kind", "__ts": "ts"}
    ).filter((F.col("kind") == "poll_end") & (F.col("__kind") == "poll_start"))
    call = F.struct(F.col("__ts").alias("start"), F.col("ts").alias("end"))
    stacked = ends.select(*keys, *_ORDER, call.alias("__call")).unionByName(
        calls.filter(F.col("kind") == "poll_register").select(*keys, *_ORDER, *file),
        allowMissingColumns=True,
    )
    # the call that ends next takes the files registered before it; ends carry no file
    known = with_last_known(stacked, keys, _ORDER, {"__in": "__call"}, cell, following=True)
    registered = known.filter(F.col("__call").isNull())
    taken = (
        registered.filter(F.col("__in").isNotNull())
        .groupBy(*keys, F.col("__in.start").alias("__start"), F.col("__in.end").alias("end"), *file)
        .agg(F.max("ts").alias("__since"))
    )
    still = open_events(moves, keys, "poll_start", "poll_end", order=_ORDER).withColumnRenamed("start", "__start")
    waiting = join_groups(
        registered.filter(F.col("__in").isNull()).groupBy(*keys, *file).agg(F.max("ts").alias("__since")), still, keys
    )
    taken = taken.unionByName(waiting, allowMissingColumns=True)
    waits = taken.select(
        F.lit(False).alias("is_epoll"),
        _packed_thread().cast("decimal(20,0)").alias("poll_id"),
        *file,
        F.greatest("__since", "__start").alias("start"),
        "end",
    )
    return call_times(waits, [*_SET, *file], bucket, _limit(events, horizon)).withColumnRenamed(
        "total_requests", "count"
    )


def epoll_timeline(
    events: DataFrame, cell_width: int | None = 3600 * NS_PER_S, file: Sequence[str] = FILE
) -> DataFrame:
    """Epoll events with ``delta`` (change in waiting threads) and ``waiting`` (threads after it).

    A thread counts once however often it enters without leaving (a lost event must not
    leave a set active for ever); leaving without having entered changes nothing.
    """
    epoll = events.filter(F.col("kind").startswith("epoll"))
    cell = None if cell_width is None else time_cell(F.col("ts"), cell_width)
    moves = with_neighbours(
        epoll.filter(F.col("kind").isin("epoll_start", "epoll_end")).select("poll_id", "pid", "tid", "kind", *_ORDER),
        ["poll_id", "pid", "tid"], _ORDER, cell, previous={"__kind": "kind"},
    )
    inside = F.coalesce(F.col("__kind") == "epoll_start", F.lit(False))
    delta = F.when((F.col("kind") == "epoll_start") & ~inside, 1).when((F.col("kind") == "epoll_end") & inside, -1)
    changes = moves.withColumn("delta", delta).filter(F.col("delta").isNotNull()).select(
        "poll_id", "kind", *_ORDER, "delta"
    )
    files = epoll.filter(F.col("kind").isin("epoll_insert", "epoll_remove")).select(
        "poll_id", "kind", *_ORDER, F.lit(0).alias("delta"), *file
    )
    return with_running_sum(
        changes.unionByName(files, allowMissingColumns=True), ["poll_id"], _ORDER, {"waiting": "delta"}, cell
    )


def active_sessions(timeline: DataFrame, cell_width: int | None = 3600 * NS_PER_S) -> DataFrame:
    """When each epoll set is active: from the first thread that enters to the last that leaves."""
    opens = (F.col("delta") == 1) & (F.col("waiting") == 1)
    closes = (F.col("delta") == -1) & (F.col("waiting") == 0)
    cell = None if cell_width is None else time_cell(F.col("ts"), cell_width)
    borders = timeline.filter(opens | closes).select("poll_id", *_ORDER, "delta")
    return with_neighbours(borders, ["poll_id"], _ORDER, cell, following={"end": "ts"}).filter(
        F.col("delta") == 1
    ).select("poll_id", F.col("ts").alias("start"), "end")


def file_registrations(
    timeline: DataFrame,
    file: Sequence[str] = FILE,
    idle_removals: bool = False,
    cell_width: int | None = 3600 * NS_PER_S,
) -> DataFrame:
    """When each file belongs to each epoll set: ``since``, ``until`` (NULL: still registered).

    Inserting a file again changes nothing. A removal counts only while the set is
    active, unless ``idle_removals``; ``in_session`` says whether it was.
    """
    rows = timeline.filter(F.col("kind").isin("epoll_insert", "epoll_remove"))
    if not idle_removals:
        rows = rows.filter((F.col("kind") == "epoll_insert") | (F.col("waiting") > 0))
    keys = ["poll_id", *file]
    cell = None if cell_width is None else time_cell(F.col("ts"), cell_width)
    seen = with_neighbours(rows.select(*keys, *_ORDER, "kind", "waiting"), keys, _ORDER, cell, previous={"__kind": "kind"})
    registered = F.coalesce(F.col("__kind") == "epoll_insert", F.lit(False))
    changes = seen.filter(F.when(F.col("kind") == "epoll_insert", ~registered).otherwise(registered)).drop("__kind")
    spans = with_neighbours(changes, keys, _ORDER, cell, following={"until": "ts", "__waiting": "waiting"})
    return spans.filter(F.col("kind") == "epoll_insert").select(
        *keys, F.col("ts").alias("since"), "until", (F.col("__waiting") > 0).alias("in_session")
    )


def settled_history(
    events: DataFrame, cell_width: int | None = 3600 * NS_PER_S, file: Sequence[str] = FILE, idle_removals: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Timeline and registrations of epoll sets, written once for all that is read off them."""
    timeline = settle(epoll_timeline(events, cell_width, file))
    return timeline, settle(file_registrations(timeline, file, idle_removals, cell_width))


def _epoll_file_wait(
    events: DataFrame,
    bucket: int,
    horizon: int | None,
    cell_width: int | None,
    file: Sequence[str],
    idle_removals: bool,
    history: tuple[DataFrame, DataFrame] | None,
) -> DataFrame:
    """Files of epoll sets: waited for while registered *and* the set is active.

    No file × session pairs are formed. A registration that covers a whole bucket takes
    the set's activity of that bucket; where it starts or ends inside a bucket, the
    activity up to that moment is read off a running sum over the bucket's sessions.

    The timeline, and the sessions and registrations read off it, feed several branches
    each, so they are written once instead of being computed again by every branch.
    """
    timeline, spans = history or settled_history(events, cell_width, file, idle_removals)
    sessions = settle(active_sessions(timeline, cell_width))
    done = F.col("end").isNotNull()
    stop = F.coalesce(F.col("end"), _limit(events, horizon))
    pieces = split_by_bucket(sessions.withColumn("__stop", stop), bucket, "start", "__stop", touch_end=True, clipped=True)
    pieces = pieces.withColumn("closes", (done & (F.col("bucket") == floor_to(F.col("end"), bucket))).cast("bigint"))
    totals = settle(
        pieces.groupBy("poll_id", "bucket").agg(
            F.sum("slice").alias("active"), F.sum(F.coalesce("closes", F.lit(0))).alias("closes")
        )
    )
    unit = F.lit(bucket).cast("bigint")
    last = totals.agg(F.max("bucket")).scalar()
    spread = explode_range(
        spans,
        floor_div(F.col("since"), bucket * _COARSE),
        floor_div(F.least(F.coalesce("until", last), last), bucket * _COARSE),
        "__coarse",
    )
    # equi join on (set, coarse time); every row it yields is a row of the result
    covered = spread.join(
        totals.withColumn("__coarse", floor_div(F.col("bucket"), bucket * _COARSE)), ["poll_id", "__coarse"]
    ).filter(
        (F.col("bucket") >= floor_to(F.col("since"), bucket))
        & (F.col("until").isNull() | (F.col("bucket") <= floor_to(F.col("until"), bucket)))
    )
    keys = ["poll_id", "bucket", *file]
    starts_inside = F.col("since") > F.col("bucket")
    ends_inside = F.col("until").isNotNull() & (F.col("until") < F.col("bucket") + unit)
    whole = covered.select(
        *keys,
        F.when(~ends_inside, F.col("active")).otherwise(F.lit(0)).alias("time"),
        F.when(~ends_inside, F.col("closes")).otherwise(F.lit(0)).alias("count"),
    )
    moments = covered.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(starts_inside, F.col("since")).alias("at"), F.lit(-1).alias("sign")),
                    F.struct(F.when(ends_inside, F.col("until")).alias("at"), F.lit(1).alias("sign")),
                ),
                lambda m: m["at"].isNotNull(),
            )
        ).alias("m"),
    ).select(*keys, F.col("m.at").alias("at"), F.col("m.sign").alias("sign"))
    # activity before t = t·(starts − ends) − (sum of starts − sum of ends), within the bucket
    edges = pieces.select(
        "poll_id",
        "bucket",
        F.explode(
            F.array(
                F.struct(F.col("slice_start").alias("at"), F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("closed")),
                F.struct(
                    F.col("slice_end").alias("at"), F.lit(-1).alias("step"),
                    F.coalesce("closes", F.lit(0)).cast("bigint").alias("closed"),
                ),
            )
        ).alias("e"),
    ).select(
        "poll_id", "bucket", F.col("e.at").alias("at"), F.col("e.step").cast("bigint").alias("step"),
        ((F.col("e.at") - F.col("bucket")) * F.col("e.step")).alias("moment"), F.col("e.closed").alias("closed"),
        F.lit(0).alias("late"),
    )
    stacked = edges.unionByName(moments.withColumn("late", F.lit(1)), allowMissingColumns=True)
    fine = time_cell(F.col("at"), max(bucket // 64, 1))
    run = with_running_sum(
        stacked, ["poll_id", "bucket"], ["at", "late"],
        {"__open": "step", "__moment": "moment", "__closed": "closed"}, fine,
    ).filter(F.col("late") == 1)
    elapsed = (F.col("at") - F.col("bucket")) * F.col("__open") - F.col("__moment")
    partial = run.select(
        *keys, (elapsed * F.col("sign")).alias("time"), (F.col("__closed") * F.col("sign")).alias("count")
    )
    removed = spans.filter(F.col("in_session")).select(
        "poll_id", floor_to(F.col("until"), bucket).alias("bucket"), *file,
        F.lit(0).cast("bigint").alias("time"), F.lit(1).cast("bigint").alias("count"),
    )
    return (
        whole.unionByName(partial).unionByName(removed)
        .groupBy("bucket", "poll_id", *file)
        .agg(F.sum("time").alias("total_time"), F.sum("count").alias("count"))
        .filter((F.col("total_time") > 0) | (F.col("count") > 0))
        .select("bucket", F.lit(True).alias("is_epoll"), F.col("poll_id").cast("decimal(20,0)"), *file, "total_time", "count")
    )


def muxio_file_wait(
    events: DataFrame,
    bucket: int = NS_PER_S,
    horizon: int | None = None,
    cell_width: int | None = 3600 * NS_PER_S,
    file: Sequence[str] = FILE,
    idle_removals: bool = False,
    history: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Time each file was waited for through a poll or epoll set, split by bucket.

    ``history``: :func:`settled_history` of the same events, where it is there already.
    """
    polls = _poll_file_wait(events, bucket, horizon, cell_width, file)
    epolls = _epoll_file_wait(events, bucket, horizon, cell_width, file, idle_removals, history)
    return polls.unionByName(epolls)


def open_state(
    events: DataFrame,
    at: int,
    cell_width: int | None = 3600 * NS_PER_S,
    file: Sequence[str] = FILE,
    idle_removals: bool = False,
    history: tuple[DataFrame, DataFrame] | None = None,
    with_files: bool = True,
) -> DataFrame:
    """What is still open at the end of ``events``, as events at time ``at``.

    Replaying these rows before later events continues all waits: threads inside a set,
    files registered with it, and files registered for a poll call that has not ended.
    Their sequence numbers sort before those of real events. Waits of threads alone need no files (``with_files``).
    """
    columns = ["kind", *_ORDER, "poll_id", "pid", "tid", *file]

    def as_events(df: DataFrame, kind: str, seq: int) -> DataFrame:
        made = df.withColumns({"kind": F.lit(kind), "ts": F.lit(at).cast("bigint"), "seq": F.lit(seq).cast("bigint")})
        kinds = {f.name: f.dataType for f in events.schema}
        return made.select(*[
            (F.col(c) if c in made.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns
        ])

    inside = open_events(events, ["poll_id", "pid", "tid"], "epoll_start", "epoll_end", order=_ORDER)
    polling = open_events(events, ["pid", "tid"], "poll_start", "poll_end", order=_ORDER)
    threads = as_events(inside, "epoll_start", -1).unionByName(as_events(polling, "poll_start", -1))
    if not with_files:
        return threads
    spans = history[1] if history else file_registrations(epoll_timeline(events, cell_width, file), file, idle_removals, cell_width)
    files = spans.filter(F.col("until").isNull())
    ended = pair_events(
        events, ["pid", "tid"], "poll_start", "poll_end", order=_ORDER, cell_width=cell_width
    ).groupBy("pid", "tid").agg(F.max("end").alias("__ended"))
    waiting = (
        join_groups(events.filter(F.col("kind") == "poll_register"), ended, ["pid", "tid"], "left")
        .filter(F.col("__ended").isNull() | (F.col("ts") > F.col("__ended")))
        .select("pid", "tid", *file)
        .distinct()
    )
    return (
        as_events(files, "epoll_insert", -3)
        .unionByName(as_events(waiting, "poll_register", -2))
        .unionByName(threads)
    )
