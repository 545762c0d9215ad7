"""Poll/epoll waits over a stream: keyed state, event-time order, open waits accounted.

Events are buffered in state until the watermark has passed their bucket, then replayed
in time order, so late arrival within the delay does not change the result. When a
bucket closes, waits that are still open are accounted up to its end without being
counted. The state of a set is its open threads, its registered files and the buffer. It is
bounded by events: a thread that exits (``thread_exit``) and a set that is closed (``set_closed``)
end their open waits uncounted and are forgotten; nothing is forgotten by age.

A set has one timer, and what has closed since the last one is replayed at once: threads by whole columns, files
along the sessions in which some thread waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from slowtrace.streaming.shards import CHUNK, added, held, in_pieces, next_moves, pack, spread, unpack

OUTPUT = StructType([
    StructField("poll_id", StringType()),
    StructField("bucket", LongType()),
    StructField("what", StringType()),
    StructField("name", StringType()),
    StructField("total_time", LongType()),
    StructField("total_requests", LongType()),
])

_EVENTS = pa.schema([
    ("ts", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("thread", pa.string()), ("file", pa.string()),
])
_SINCE = pa.schema([("name", pa.string()), ("since", pa.int64())])
_CURSOR = StructType([StructField("bucket", LongType()), StructField("session", LongType())])
_START, _END, _QUIT = 0, 1, 2
_MOVES = {"epoll_start": _START, "epoll_end": _END, "thread_exit": _QUIT}


class WaitMachine(StatefulProcessor):
    """One poll set. Times are microseconds; timers are milliseconds of event time."""

    def __init__(self, bucket: int):
        self._bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffer = handle.getListState("buffer", CHUNK)
        self._threads = handle.getValueState("threads", CHUNK)
        self._files = handle.getValueState("files", CHUNK)
        self._cursor = handle.getValueState("cursor", _CURSOR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = [batch[_EVENTS.names] for batch in rows]
        if batches:
            events = pd.concat(batches)
            self._buffer.appendValue(pack(events, _EVENTS))
            self._wake(int(events["ts"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // self._bucket * self._bucket
        cursor, session = self._cursor.get() if self._cursor.exists() else (None, None)
        if cursor is not None and cursor >= closed:
            return  # another timer of this batch has been here
        waiting = unpack(held(self._buffer), _EVENTS)
        threads, files = (unpack([s.get()] if s.exists() else [], _SINCE) for s in (self._threads, self._files))
        due = waiting["ts"] < closed
        rest = waiting[~due]
        events = waiting[due].sort_values(["ts", "seq"], kind="stable", ignore_index=True)
        told = np.iinfo(np.int64).min if cursor is None else cursor
        waits, borders, threads = self._thread_waits(events, threads, told, closed)
        file_waits, files, session = self._file_waits(events, borders, files, session, told, closed)
        for state, now in ((self._threads, threads), (self._files, files)):
            state.update(pack(now, _SINCE))
        self._cursor.update((closed, session))
        if len(events):
            self._buffer.clear()
            if len(rest):
                self._buffer.put([pack(rest, _EVENTS)])
        if len(threads):
            self._wake(closed)
        elif len(rest):
            self._wake(int(rest["ts"].min()))
        for what, rows in (("thread", waits), ("file", file_waits)):
            yield from in_pieces(rows.assign(poll_id=_text(key[0]), what=what)[OUTPUT.names])

    def _wake(self, ts: int) -> None:
        self._handle.registerTimer((ts // self._bucket + 1) * self._bucket // 1000)

    def _thread_waits(self, events: pd.DataFrame, inside: pd.DataFrame, told: int, closed: int) -> tuple:
        """Waits of threads, the borders of the sessions of the set (place in ``events``, time, ended) and who is inside."""
        close_rank = np.flatnonzero(events["kind"] == "set_closed")
        close_ts = events["ts"].to_numpy(np.int64)[close_rank]
        moves = events[events["kind"].isin(_MOVES)]
        code, names = pd.factorize(pd.concat([inside["name"], moves["thread"]]), use_na_sentinel=False)
        # threads inside come before all events
        rank = np.concatenate([np.full(len(inside), -1), moves.index.to_numpy(np.int64)])
        order = np.lexsort((rank, code))
        code, rank = code[order], rank[order]
        ts = np.concatenate([inside["since"].to_numpy(np.int64), moves["ts"].to_numpy(np.int64)])[order]
        kind = np.concatenate([np.full(len(inside), _START), moves["kind"].map(_MOVES).to_numpy(np.int64)])[order]
        kind_after, ts_after = next_moves(code, rank, ts, kind, close_rank, close_ts, _QUIT)

        start = kind == _START
        done, still = start & (kind_after == _END), start & (kind_after == -1)
        until = np.select([still, kind_after == _START], [np.full(len(ts), closed), ts_after // self._bucket * self._bucket], ts_after)
        waits = self._per_bucket(names, code[start], np.maximum(ts, told)[start], until[start], code[done], ts_after[done])

        # a thread counts once, however often it enters without leaving
        again = np.append(False, (code[1:] == code[:-1]) & start[:-1] & (kind_after[:-1] == _START)) if len(code) else start
        enters, leaves = start & ~again, start & ((kind_after == _END) | (kind_after == _QUIT))
        rank_after = np.where(leaves, self._leave_rank(code, rank, close_rank), 0)
        at = np.concatenate([rank[enters], rank_after[leaves]])
        step = np.concatenate([np.ones(enters.sum(), np.int64), np.full(leaves.sum(), -1)])
        # one event changes the number of threads inside once; a closed set lets all of them go
        _, at, step = added(np.zeros(len(at), np.int64), at, step)
        number = np.cumsum(step)
        before = np.append(0, number[:-1]) if len(number) else number
        border = (number == 0) != (before == 0)
        kinds = events["kind"].to_numpy(object)
        times = events["ts"].to_numpy(np.int64)
        borders = {int(r): (int(times[r]), kinds[r] == "epoll_end") for r in at[border] if r >= 0}
        return waits, borders, pd.DataFrame({"name": np.asarray(names, object)[code[still]], "since": ts[still]})

    @staticmethod
    def _leave_rank(code: np.ndarray, rank: np.ndarray, close_rank: np.ndarray) -> np.ndarray:
        """Place of the event that follows each one: its thread's next one, or the set being closed before that."""
        last = np.iinfo(np.int64).max
        after = np.where(np.append(code[1:] == code[:-1], False), np.roll(rank, -1), last) if len(code) else rank
        if len(close_rank):
            after = np.minimum(after, np.append(close_rank, last)[np.searchsorted(close_rank, rank, side="right")])
        return after

    def _file_waits(self, events: pd.DataFrame, borders: dict, files: pd.DataFrame, session, told: int, closed: int) -> tuple:
        """Waits for files, the files registered and the start of the session at ``closed``."""
        since = dict(zip(files["name"], files["since"].tolist(), strict=True))
        spans, counts = [], []

        def account(name, until: int, count: int) -> None:
            spans.append((name, max(since[name], session, told), until))
            if count:
                counts.append((name, until))

        kinds = events["kind"].to_numpy(object)
        wanted = np.union1d(
            np.flatnonzero(np.isin(kinds.astype(str), ["epoll_insert", "epoll_remove", "set_closed"])),
            np.fromiter(borders, np.int64, len(borders)))
        chosen = events.iloc[wanted]
        for place, ts, kind, file in zip(wanted.tolist(), chosen["ts"].tolist(), chosen["kind"], chosen["file"], strict=True):
            if place in borders and kind == "epoll_start":
                session = ts
            elif place in borders:
                for name in since:
                    account(name, ts, int(borders[place][1]))
                session = None
            elif kind == "epoll_insert":
                since.setdefault(file, ts)
            elif kind == "epoll_remove" and session is not None and file in since:
                account(file, ts, 1)
                del since[file]
            if kind == "set_closed":
                since.clear()
        if session is not None:
            for name in since:
                account(name, closed, 0)
        name, begin, end = ([s[i] for s in spans] for i in range(3))
        code, names = pd.factorize(pd.Series([*name, *[c[0] for c in counts]], dtype=object), use_na_sentinel=False)
        waits = self._per_bucket(
            names, code[:len(name)], np.array(begin, np.int64), np.array(end, np.int64),
            code[len(name):], np.array([c[1] for c in counts], np.int64))
        return waits, pd.DataFrame({"name": pd.Series([*since], dtype=object), "since": pd.Series([*since.values()], dtype="int64")}), session

    def _per_bucket(self, names, code, since, until, done_code, done_at) -> pd.DataFrame:
        """Time of spans and number of ends per name and bucket."""
        code, bucket, time = spread(code, since, until, self._bucket)
        code, bucket, time, number = added(
            np.concatenate([code, done_code]), np.concatenate([bucket, done_at // self._bucket * self._bucket]),
            np.concatenate([time, np.zeros(len(done_code), np.int64)]),
            np.concatenate([np.zeros(len(time), np.int64), np.ones(len(done_code), np.int64)]))
        return pd.DataFrame({
            "bucket": bucket, "name": np.asarray(names, object)[code], "total_time": time, "total_requests": number})

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def streaming_waits(
    events: DataFrame,
    bucket_us: int,
    delay: str = "2 seconds",
    event_time: str = "event_time",
) -> DataFrame:
    """Thread and file waits per closed bucket of every epoll set.

    ``events(poll_id string, event_time timestamp, ts long µs, seq, kind, thread string,
    file string)``; kinds are ``epoll_start``, ``epoll_end``, ``epoll_insert``, ``epoll_remove``,
    ``thread_exit`` and ``set_closed``. Exits are reported to each set the thread was in.
    """
    return (
        events.withWatermark(event_time, delay)
        .groupBy("poll_id")
        .transformWithStateInPandas(
            WaitMachine(bucket_us), OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )


def thread_waits(machine_output: DataFrame) -> DataFrame:
    return machine_output.filter(F.col("what") == "thread").drop("what")


def file_waits(machine_output: DataFrame) -> DataFrame:
    return machine_output.filter(F.col("what") == "file").drop("what")
