"""Shards along a Hilbert curve through several metadata columns.

Each dimension is cut into cells of about equal row counts, the cells of a row give its place on the curve, and the
rows in curve order are cut into runs. A run covers a compact box of every dimension, so the minimum and maximum that
Parquet keeps per file prune files for filters on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slowtrace.session import settle


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, each below ``2**bits``)."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for shift in range(bits - 1, 0, -1):
        # undo, from the coarsest cell down, how the curve turns and mirrors inside it
        low, inside = (1 << shift) - 1, 1 << shift
        for d in range(len(x)):
            upper = (x[d] & inside) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << shift), turn ^ ((1 << shift) - 1), turn)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | (((axis ^ turn) >> bit) & 1)
    return place


def with_text_order(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: how many rows have a smaller text in ``column`` (by whole UTF-8 bytes); null as null.

    Distinct texts with their counts are range-sorted; a text's number is the running sum inside its range plus the
    rows of the ranges before it (one number per range).
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranges = settle(values.repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    sums = ranges.groupBy("__range").agg(F.sum("__n").alias("__all"))
    before = sums.select("__range", (F.sum("__all").over(Window.orderBy("__range")) - F.col("__all")).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy("__range").orderBy(column)) - F.col("__n")
    order = settle(ranges.withColumn("__within", within).join(F.broadcast(before), "__range")
                   .select(F.col(column).alias("__value"), (F.col("__before") + F.col("__within")).alias(name)))
    return df.join(order, F.col(column) == F.col("__value"), "left").drop("__value")


def curve_order(df: DataFrame, dims: Sequence[Column], bits: int = 5, accuracy: int = 1_000) -> DataFrame:
    """``df`` with ``curve``: the place of each row. Cell borders come from quantiles of all rows; a null lies first."""
    names = [f"__dim{i}" for i in range(len(dims))]
    framed = df.select("*", *[F.coalesce(d.cast("double"), F.lit(float("-inf"))).alias(n)
                              for d, n in zip(dims, names, strict=True)])
    steps = [i / 2 ** bits for i in range(1, 2 ** bits)]
    borders = [np.array(b or [], dtype=float) for b in
               framed.agg(*[F.percentile_approx(n, steps, accuracy).alias(n) for n in names]).first()]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        cells = [np.searchsorted(b, c.to_numpy(float), side="left") for b, c in zip(borders, columns, strict=True)]
        return pd.Series(curve_index(np.stack(cells, axis=1), bits))

    return framed.withColumn("curve", place(*names)).drop(*names)


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: rows in ``order`` cut into runs whose counts differ by one at most.

    Rows are range-sorted once; a row's rank is its place in its range plus the rows of the ranges before it (one
    count per range). Rows that are equal in ``order`` are ranked in any order. An empty table gives no rows.
    """
    ranges = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"),
                           F.sum("__n").over(Window.partitionBy()).alias("__total"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    rank, total = F.col("__before") + F.col("__within"), F.col("__total")
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return (ranges.withColumn("__within", within).join(F.broadcast(before), "__range")
            .withColumn("__rank", rank).withColumn("shard", F.expr(f"(__rank * {shards}) div __total").cast("int"))
            .withColumn("slot", F.col("__rank") - first).drop("__range", "__n", "__within", "__before", "__total", "__rank"))


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, shard, slot.

    Dimensions are lang, source and size; ties along the curve go by text (equal texts lie side by side), then
    doc_id. Nulls in any of them lie first; a null text has size 1 and the checksum of an empty text. Repeated rows
    get a slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = settle(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.monotonically_increasing_id().alias("__row"),
    ))
    ordered = with_text_order(with_text_order(meta, "__lang", "__lang_at"), "__source", "__source_at").drop("__lang", "__source")
    dims = [F.col("__lang_at"), F.col("__source_at"), F.col("size")]
    placed = curve_order(settle(ordered), dims, bits).drop("__lang_at", "__source_at")
    return cut_runs(placed, ["curve", "text_crc32", "doc_id", "__row"], shards).drop("__row")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as one folder per shard, in curve order, with bounded files.

    ``assigned`` comes from :func:`shard_documents`; rows meet by doc_id and text checksum (nulls included), rows
    equal in both are written once each. The folders are named ``shard_id=…``, with as many underscores behind the name
    as keep it apart from the columns of ``docs``.
    """
    folder = "shard_id"
    while folder in docs.columns:
        folder += "_"

    def numbered(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("__nth", F.row_number().over(
            Window.partitionBy("__id", "__crc").orderBy(*order)))

    left = numbered(docs.withColumns({"__id": F.col("doc_id"), "__crc": F.crc32(F.coalesce("text", F.lit("")))}), "__id")
    right = numbered(assigned.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"),
                                     F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "__shard", "__slot")
    on = (left["__id"].eqNullSafe(right["__id"]) & (left["__crc"] == right["__crc"]) & (left["__nth"] == right["__nth"]))
    (left.join(right, on).select(*[left[c] for c in docs.columns], F.col("__shard").alias(folder), "__slot")
     .repartitionByRange(folder, "__slot").sortWithinPartitions(folder, "__slot").drop("__slot")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy(folder).parquet(path))
