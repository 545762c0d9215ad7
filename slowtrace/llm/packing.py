"""Token sequences of fixed capacity, packed by bulk-synchronous best fit.

Documents are cut into pieces; whole pieces of CAPACITY fill a sequence each. The rest is packed in rounds: pieces and
gaps are range-sorted together by size, and one distributed sweep (running sums per range, carried over by the sum of
the ranges before) gives each its nesting level, +1 for a piece and -1 for a gap. A piece and the gap that next closes
its level are a match: every piece goes to the smallest gap it fits that is left to it when larger pieces choose
first, conflicts being settled by rank. At any level there are at most two rows per size, so matching needs no large
group. Gaps shrink by what they took, and the next round begins. When no piece fits any gap, as many new sequences as
the rest must need at least are opened by its largest pieces.

Small pieces come last, as a gap may take many of them: laid end to end along all gaps, those that lie within one gap
stay there, the others are matched as above, until none of them fits a gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slowtrace.llm.tokens import encoder
from slowtrace.session import settle, settled_path

CAPACITY = 1024
END = 2
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one if they fit, else whole pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _cut(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            ids_of: list[np.ndarray] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start:start + length]
                    rows.append((i, piece, start, length, zlib.crc32(own.tobytes())))
                    ids_of.append(own)
            if not rows:
                continue
            owner, piece, start, length, crc = zip(*rows, strict=True)
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.cumsum([0, *map(len, ids_of)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids_of).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids followed by END; a null text counts as empty, so its one piece holds END alone."""
    schema = _PIECE + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, capacity, with_ids), schema)


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    return settle(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def _running(ranged: DataFrame, step: str, *order: str) -> DataFrame:
    """``ranged`` with ``running``: the sum of ``step`` up to each row in the order it was range-sorted by."""
    sums = ranged.groupBy("range").agg(F.sum(step).alias("own"))  # one row per range, at most as many as partitions
    before = sums.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    within = F.sum(step).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("within", within).join(F.broadcast(before), "range")
            .withColumn("running", F.col("before") + F.col("within")).drop("before", "within", "range"))


def _opened(items: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Open sequences with the largest of ``items``: (the items that open them, the others)."""
    classes = items.groupBy("length").agg(F.count("*").alias("n"), F.min("item").alias("first"))
    counts = {r["length"]: r for r in classes.collect()}  # at most ``capacity`` rows
    total = sum(length * r["n"] for length, r in counts.items())
    over_half = sum(r["n"] for length, r in counts.items() if 2 * length > capacity)
    need, border, share = max(-(-total // capacity), over_half), capacity + 1, 1.0
    for length in sorted(counts, reverse=True):
        n = counts[length]["n"]
        border, share = length, min(1.0, need / n)
        need -= n
        if need <= 0:
            break
    # of equal lengths at the border a share chosen by hash, and one at least
    lucky = (F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < int(share * (1 << 20))) | (F.col("item") == counts[border]["first"])
    opens = (F.col("length") > border) | ((F.col("length") == border) & lucky)
    return items.where(opens), items.where(~opens)


class _Tables:
    """Tables of one schema written by the rounds, kept as paths and read by one scan, so that plans stay small."""

    def __init__(self, spark: SparkSession, schema: str):
        self._spark, self._schema, self._paths = spark, schema, []

    def add(self, df: DataFrame) -> DataFrame:
        self._paths.append(settled_path(df))
        return self._spark.read.schema(df.schema).parquet(self._paths[-1])

    def rows(self) -> DataFrame:
        if not self._paths:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*self._paths)


_STATE = "size long, kind int, id long, next_kind int, next_id long, next_size long, last_kind int"
_MATCH = "kind = 0 AND next_kind = 1"


def _matched(items: DataFrame, gaps: DataFrame, states: _Tables) -> tuple[DataFrame, DataFrame]:
    """One round of best fit: (the items without a place, the gaps that are left). Places are in ``states``."""
    rows = items.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("item").alias("id")).union(
        gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("sequence_id").alias("id")))
    order = ("size", "kind", "id")
    swept = _running(_ranged(rows.withColumn("step", 1 - 2 * F.col("kind")), *order), "step", *order)
    level = Window.partitionBy("level").orderBy(*order)
    state = states.add(swept.withColumn("level", F.col("running") + F.col("kind"))
                       .withColumns({"next_kind": F.lead("kind").over(level), "next_id": F.lead("id").over(level),
                                     "next_size": F.lead("size").over(level), "last_kind": F.lag("kind").over(level)})
                       .select(*order, "next_kind", "next_id", "next_size", "last_kind"))
    items = state.where("kind = 0 AND NOT next_kind <=> 1").select(F.col("id").alias("item"), F.col("size").alias("length"))
    # a matched item leaves the rest of its gap, an unmatched gap stays
    matched, alone = F.expr(_MATCH), F.expr("kind = 1 AND NOT last_kind <=> 0")
    gaps = state.where(matched | alone).select(
        F.when(matched, F.col("next_id")).otherwise(F.col("id")).alias("sequence_id"),
        F.when(matched, F.col("next_size") - F.col("size")).otherwise(F.col("size")).alias("gap")).where("gap > 0")
    return items, gaps


_LAID = "item long, length long, sequence_id long, gap long, offset long"


def _laid(items: DataFrame, gaps: DataFrame, capacity: int, small: int, laid: _Tables) -> tuple[DataFrame, DataFrame]:
    """Items below ``small`` end to end along all gaps, the largest of both first; results as of :func:`_matched`."""
    def along(df: DataFrame, size: str, key: str) -> DataFrame:
        order = ("__down", key)
        chain = _running(_ranged(df.withColumn("__down", -F.col(size)), *order), size, *order)
        return chain.withColumn("at", F.col("running") - F.col(size)).drop("running", "__down")

    cell = along(gaps, "gap", "sequence_id").select("sequence_id", "gap", F.col("at").alias("begin"), F.explode(
        F.expr(f"sequence(at div {small}, (at + gap - 1) div {small})")).alias("cell"))
    chain = along(items, "length", "item")
    met = (chain.withColumn("cell", F.expr(f"at div {small}")).join(cell, "cell")
           .where("at >= begin AND at + length <= begin + gap"))
    # what lies within one gap is one run; it begins where the gap does
    first = F.min("at").over(Window.partitionBy("sequence_id"))
    inside = laid.add(met.select("item", "length", "sequence_id", "gap",
                                 (F.lit(capacity) - F.col("gap") + F.col("at") - first).cast("long").alias("offset")))
    taken = inside.groupBy("sequence_id").agg(F.sum("length").alias("taken"))
    left = (gaps.join(taken, "sequence_id", "left")
            .select("sequence_id", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"))
    return items.join(inside.select("item"), "item", "left_anti"), left


def _sizes(items: DataFrame, gaps: DataFrame):
    """Number and least length of the items, and the widest gap, by one job."""
    none = F.lit(None).cast("long")
    both = items.select("length", none.alias("gap")).union(gaps.select(none, "gap"))
    return both.agg(F.count("length").alias("n"), F.min("length").alias("least"), F.max("gap").alias("widest")).first()


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item unique long, length from 1 to ``capacity``)."""
    spark, small = items.sparkSession, max(2, capacity // 16)
    items = settle(items)
    states, openings, laid = _Tables(spark, _STATE), _Tables(spark, "item long, length long"), _Tables(spark, _LAID)
    closed = _Tables(spark, "sequence_id long, gap long")  # gaps too small for any large piece, not for small ones
    gaps = closed.rows()
    tiny, items, at_tiny = items.where(F.col("length") < small), items.where(F.col("length") >= small), False
    while True:
        left = _sizes(items, gaps)
        if not left["n"]:
            if at_tiny:
                break
            closed.add(gaps)
            items, gaps, at_tiny = tiny, closed.rows(), True
            continue
        if left["widest"] is None or left["least"] > left["widest"]:
            # gaps that fit nothing of this size now never will
            if not at_tiny and left["widest"] is not None:
                closed.add(gaps)
            opening, items = _opened(items, capacity)
            opening = openings.add(opening.select("item", "length"))
            gaps = (opening.select(F.col("item").alias("sequence_id"), (F.lit(capacity) - F.col("length")).alias("gap"))
                    .where("gap > 0"))
        if at_tiny:
            items, gaps = _laid(items, gaps.where(F.col("gap") >= left["least"]), capacity, small, laid)
            items, gaps = settle(items), settle(gaps)
        items, gaps = _matched(items, gaps, states)
    first = F.lit(0).cast("long").alias("offset")
    return (openings.rows().select("item", F.col("item").alias("sequence_id"), first)
            .union(states.rows().where(_MATCH).select("id", "next_id", F.lit(capacity) - F.col("next_size")))
            .union(laid.rows().select("item", "sequence_id", "offset")))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) with sequence_id and offset; every sequence is gapless from 0.

    Repeated rows are packed once each; an empty table gives no rows.
    """
    numbered = settle(pieces.withColumn("item", F.monotonically_increasing_id()))
    whole = numbered.where(F.col("length") == capacity)
    rest = numbered.where(F.col("length") < capacity)
    places = best_fit(rest.select("item", "length"), capacity)
    return (whole.withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
            .unionByName(rest.join(places, "item").select(*whole.columns, "sequence_id", "offset"))).drop("item")
