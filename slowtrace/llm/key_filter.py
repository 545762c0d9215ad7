"""Semi-join reduction: a filter of fixed size that passes every wanted key and few others.

Before rows with texts are shuffled to meet a list of keys, those that cannot meet it are left out. The filter has
``2 ** BITS`` bits whatever the number of keys, so sending it to every task is safe at any scale; too many keys make
it pass more rows, never fewer. The join that follows decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtrace.llm.words import mix

BITS = 26
_SLICES = 64
_SLICE_BYTES = 2 ** BITS // 8 // _SLICES


def _places(keys: np.ndarray) -> np.ndarray:
    first = mix(keys.view(np.uint64))
    return np.concatenate([first >> np.uint64(64 - BITS), mix(first) >> np.uint64(64 - BITS)]).astype(np.int64)


def _set_bits(bits: np.ndarray, keys: np.ndarray) -> None:
    at = _places(keys)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(2 ** BITS // 8, np.uint8)
    for batch in batches:
        _set_bits(bits, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts = bits.reshape(_SLICES, _SLICE_BYTES)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["slice", "bits"])


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(_SLICE_BYTES, np.uint8)
    for batch in batches:
        for part in batch.column("bits").to_pylist():
            bits |= np.frombuffer(part, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                     ["slice", "bits"])


def _hit(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    at = _places(keys.to_numpy(zero_copy_only=False).astype(np.int64))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(2, -1).all(axis=0)


class KeyFilter:
    """Passes every key in column ``key`` (any expression hashed by Spark's xxhash64)."""

    def __init__(self, keys: DataFrame, *columns: str | Column):
        spark = keys.sparkSession
        hashed = keys.select(F.xxhash64(*columns).alias("key"))
        parts = (hashed.mapInArrow(_partial, "slice int, bits binary")
                 .groupBy("slice").applyInArrow(_merged, "slice int, bits binary"))
        bits = np.zeros((_SLICES, _SLICE_BYTES), np.uint8)
        for row in parts.collect():  # 8 MB in all
            bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
        self._bits = spark.sparkContext.broadcast(bits.reshape(-1))

    def mask(self, keys: pa.Array) -> np.ndarray:
        """Which of ``keys`` (column xxhash64 of what the filter was made of) pass; for code inside tasks."""
        return _hit(self._bits.value, keys)

    def passes(self, *columns: str | Column) -> Column:
        shared = self._bits

        @F.arrow_udf("boolean")
        def maybe(key: pa.Array) -> pa.Array:
            return pa.array(_hit(shared.value, key))

        return maybe(F.xxhash64(*columns))

    def release(self) -> None:
        """Removes the filter everywhere. Whatever used it must have been written."""
        self._bits.destroy()


def without(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` (nulls are equal) are no row of ``gone``. What the filter leaves out stays where it is."""
    gone = gone.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in columns))
    some = KeyFilter(gone, *columns)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    met = rows.where(some.passes(*columns)).alias("m").join(gone.alias("g"), same, "left_anti")
    return rows.where(~some.passes(*columns)).unionByName(met)
