"""Many keys in one state, and the arithmetic on whole columns that goes with it.

A state per key costs a Python call and several round trips to the state store for every key and micro-batch, however
little it holds. Keys that are many and small therefore share a state with others of the same hash. What a shard holds is
kept as Arrow bytes: appended as it comes, read once when time has moved on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

CHUNK = StructType([StructField("data", BinaryType())])
TIME = StructType([StructField("at", LongType())])
_ROWS_OUT = 200_000
_EXACT = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def as_text(columns) -> Column:
    """Columns as one text that tells all their values apart, NULL too."""
    return F.to_json(F.struct(*columns), _EXACT) if columns else F.lit("{}")


def from_text(text: str, fields: StructType) -> Column:
    return F.from_json(text, fields, {k: v for k, v in _EXACT.items() if k != "ignoreNullFields"})


def pack(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    table = pa.Table.from_pandas(rows, schema=schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpack(chunks, schema: pa.Schema) -> pd.DataFrame:
    """The rows of all ``chunks``, in order."""
    tables = [pa.ipc.open_stream(pa.py_buffer(bytes(c[0]))).read_all() for c in chunks]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()


def held(state) -> Iterator[tuple]:
    """What a list state holds; nothing where it is empty."""
    return state.get() if state.exists() else iter(())


def in_pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), _ROWS_OUT):
        yield rows.iloc[at:at + _ROWS_OUT]


def next_moves(
    code: np.ndarray, rank: np.ndarray, ts: np.ndarray, kind: np.ndarray, close_rank: np.ndarray, close_ts: np.ndarray,
    close_kind: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Kind and time of the event that follows each one of the same code; -1 where there is none.

    Rows are ordered by code and ``rank``, their place in time. Events at ``close_rank`` follow those of every code.
    """
    same = np.append(code[1:] == code[:-1], False) if len(code) else np.zeros(0, bool)
    kind_after, ts_after = np.where(same, np.roll(kind, -1), -1), np.where(same, np.roll(ts, -1), 0)
    if len(close_rank):
        rank_after = np.where(same, np.roll(rank, -1), np.iinfo(np.int64).max)
        at = np.searchsorted(close_rank, rank, side="right")
        there = np.minimum(at, len(close_rank) - 1)
        cut = (at < len(close_rank)) & (close_rank[there] < rank_after)
        kind_after, ts_after = np.where(cut, close_kind, kind_after), np.where(cut, close_ts[there], ts_after)
    return kind_after, ts_after


def spread(code: np.ndarray, since: np.ndarray, until: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, bucket and time of the spans ``[since, until)``, added up, in order of code and bucket.

    The buckets a span only passes through are counted by its two ends, so the work grows with spans and rows, not with
    the buckets of every span.
    """
    some = until > since
    code, since, until = code[some], since[some], until[some]
    first, last = since // bucket, (until - 1) // bucket
    more = last > first
    codes, buckets = [code, code[more]], [first, last[more]]
    times = [np.minimum(until, (first + 1) * bucket) - since, (until - last * bucket)[more]]
    through = last > first + 1
    ends_code = np.tile(code[through], 2)
    ends_at = np.concatenate([first[through] + 1, last[through]])
    step = np.repeat(np.array([1, -1]), through.sum())
    ends_code, ends_at, step = added(ends_code, ends_at, step)
    # the steps of a code add up to nothing, so the running sum needs no restart
    passing = np.cumsum(step)[:-1]
    run = np.diff(ends_at) * (passing > 0) if len(step) else np.zeros(0, np.int64)
    offset = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    codes.append(np.repeat(ends_code[:-1], run))
    buckets.append(np.repeat(ends_at[:-1], run) + offset)
    times.append(np.repeat(passing, run) * bucket)
    code, index, time = added(np.concatenate(codes), np.concatenate(buckets), np.concatenate(times))
    return code, index * bucket, time


def added(code: np.ndarray, at: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """``values`` summed per code and ``at``, in their order."""
    if not len(code):
        return code, at, *values
    order = np.lexsort((at, code))
    code, at = code[order], at[order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])))
    return code[new], at[new], *[np.add.reduceat(v[order], new) for v in values]
