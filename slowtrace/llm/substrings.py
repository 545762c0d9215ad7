"""Removal of word sequences that repeat across documents.

A window is ``WINDOW`` consecutive words. First pass: every partition counts windows in a count-min sketch of its own, two
rows of counters, and sends the counters it filled; sketches are merged by addition, slice by slice. A window is
counted under its smallest ``GRAM``-word run, so equal windows fall in equal counters while neighbouring windows share one: a
document adds one count per distinct run, about a sixth of its words, and the smaller counter of a window never falls
below the number of documents that hold it. Counters end at two, as more says nothing new. Second pass: windows whose
estimate says "repeated" are grouped, exactly, by 96-bit hashes.

The second pass asks which counters reached two, one bit each. Up to ``SHARED_BITS`` of them are sent to every task;
beyond that the runs of each document are joined with the counters instead. Both give the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtrace.llm.key_filter import KeyFilter
from slowtrace.llm.words import WordHasher, mix, runs, texts_of
from slowtrace.session import settle, settled_tables

WINDOW, GRAM = 50, 40
SLICE_BITS = 22             # counters of a slice of a row, merged in one task: 2 ** SLICE_BITS
BYTES_PER_COUNTER = 6       # bytes of text to a counter of a row, so that some four in five stay empty
SHARED_BITS = 2 ** 30       # so many bits of the merged sketch may be sent to every task: 128 MB
_HELD = 2 ** 20             # counts a partition holds before it sends them
_ROWS = 1_000               # texts worked on at once
_SECOND, _TWICE = 0xC2B2AE3D27D4EB4F, np.uint32(1 << 31)


def window_cells(hashes: np.ndarray) -> np.ndarray:
    """What each window is counted under: the smallest hash among the runs of GRAM words inside it."""
    cells, width = runs(hashes, GRAM), 1
    need = WINDOW - GRAM + 1
    while width < need:
        step = min(width, need - width)
        cells, width = np.minimum(cells[:-step], cells[step:]), width + step
    return cells


def sketch_bits(text_bytes: int) -> int:
    """A row of the sketch for so much text has 2 to this power counters."""
    return max(SLICE_BITS, int(text_bytes // BYTES_PER_COUNTER).bit_length())


def counter_of(cells: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each cell in a row of the sketch. Cells are minima, so small numbers: mixed, they spread evenly."""
    return mix(cells ^ np.uint64(_SECOND) if row else cells) >> np.uint64(64 - bits)


def partial_sketch(cells: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(part, counters) of the sketch of ``cells``: the counters filled, by slices of its two rows, in ascending order.

    A counter is its place in the slice; the upper bit tells that it stands at two or more.
    """
    for row in range(2):
        at, n = np.unique(counter_of(cells, row, bits), return_counts=True)
        low = (at & np.uint64(2 ** SLICE_BITS - 1)).astype(np.uint32) | np.where(n > 1, _TWICE, np.uint32(0))
        parts, first = np.unique(at >> np.uint64(SLICE_BITS), return_index=True)
        for part, filled in zip(parts.tolist(), np.split(low, first[1:]), strict=True):
            yield 2 * part + row, filled.tobytes()


def added(sketches: Iterator[bytes]) -> np.ndarray:
    """The sum of sketches of one part, at most two in a counter."""
    counters = np.zeros(2 ** SLICE_BITS, np.uint8)
    for filled in sketches:
        low = np.frombuffer(filled, np.uint32)
        at = low & ~_TWICE
        counters[at] = np.minimum(counters[at] + 1 + (low >> np.uint32(31)).astype(np.uint8), 2)
    return counters


def _without(batches: Iterator[pa.RecordBatch], keys: KeyFilter | None) -> Iterator[pa.RecordBatch]:
    """Rows whose column ``key`` does not pass; a filter here saves a second Python worker beside the task's own."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            rows = batch.slice(at, _ROWS)
            yield rows if keys is None else rows.filter(pa.array(~keys.mask(rows.column("key"))))


def _sketched(bits: int, skip: KeyFilter | None):
    """Sketches of a partition: a document counts once in a cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(100_000), [], 0

        def sent() -> pa.RecordBatch:
            parts = list(partial_sketch(np.concatenate(held), bits))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int64()),
                                               pa.array([c for _, c in parts], pa.binary())], ["part", "filled"])

        for batch in _without(batches, skip):
            for text in texts_of(batch.column("text")):
                words = text.split()
                if len(words) >= WINDOW:
                    held.append(np.unique(window_cells(hasher(words))))
                    n += len(held[-1])
                if n >= _HELD:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()
    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for filled in batch.column("filled"):
            yield filled.as_py()


def _reached_bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part merged: a bit per counter, set if it reached two."""
    bits = np.packbits(added(_sketches(batches)) > 1, bitorder="little")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())],
                                     ["part", "bits"])


def _reached(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part merged: its row of the sketch and the counters that reached two."""
    part = key[0].as_py()
    at = np.flatnonzero(added(_sketches(batches)) > 1).astype(np.int64) + (part // 2 << SLICE_BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part % 2, np.int32)), pa.array(at)], ["row", "counter"])


class MergedSketch:
    """The merged sketch as tasks see it: which counters reached two."""

    def __init__(self, sketches: DataFrame, bits: int):
        whole = np.zeros((2, 2 ** bits // 8), np.uint8)
        wide = 2 ** SLICE_BITS // 8
        merged = sketches.groupBy("part").applyInArrow(_reached_bits, "part long, bits binary")
        for row in merged.toLocalIterator():  # at most SHARED_BITS in all
            at = row["part"] // 2 * wide
            whole[row["part"] % 2, at:at + wide] = np.frombuffer(row["bits"], np.uint8)
        self._shared, self._bits = sketches.sparkSession.sparkContext.broadcast(whole), bits

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        """Which cells are estimated to be in two documents or more."""
        out = np.ones(len(cells), bool)
        for row, filled in enumerate(self._shared.value):
            at = counter_of(cells, row, self._bits)
            out &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def release(self) -> None:
        self._shared.unpersist()


def _cells(bits: int, skip: KeyFilter | None):
    """Distinct cells of each document with their counters in both rows of the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(100_000)
        for batch in _without(batches, skip):
            for i, text in enumerate(texts_of(batch.column("text"))):
                words = text.split()
                if len(words) >= WINDOW:
                    cells = np.unique(window_cells(hasher(words)))
                    owner = pa.array(np.full(len(cells), i))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(owner), batch.column("text_hash").take(owner),
                        pa.array(cells.view(np.int64)), *(pa.array(counter_of(cells, row, bits).astype(np.int64)) for row in range(2)),
                    ], ["doc_id", "text_hash", "cell", "counter0", "counter1"])
    return run


def _candidates(sketch: MergedSketch | None, skip: KeyFilter | None):
    """Windows estimated to repeat, by the sketch or else by column ``cells``: two hashes, document and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(100_000)
        for batch in _without(batches, skip):
            found: list[tuple] = []
            for i, text in enumerate(texts_of(batch.column("text"))):
                parts = text.split()
                if len(parts) < WINDOW:
                    continue
                words = hasher(parts)
                cells = window_cells(words)
                if sketch is None:
                    at = np.flatnonzero(np.isin(cells.view(np.int64), batch.column("cells")[i].values.to_numpy()))
                else:
                    new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                    at = np.flatnonzero(np.repeat(sketch.repeated(cells[new]), np.diff(np.append(new, len(cells)))))
                if len(at):
                    other = (runs(words, WINDOW, _SECOND)[at] >> np.uint64(32)).astype(np.uint32)
                    found.append((runs(words, WINDOW)[at], other, np.full(len(at), i), at))
            if found:
                one, two, owner, at = (np.concatenate(part) for part in zip(*found, strict=True))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int32)), batch.column("doc_id").take(owner),
                    batch.column("text_hash").take(owner), pa.array(at.astype(np.int32)),
                ], ["one", "two", "doc_id", "text_hash", "at"])
    return run


def _cut(copies: KeyFilter | None, skip: KeyFilter | None):
    """Words left of each text, by the columns ``starts`` and ``whole``; ``copies`` tells ``whole`` where there is no such column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _without(batches, skip):
            none = [None] * len(batch)
            starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else none
            whole = batch.column("whole").to_pylist() if copies is None else copies.mask(batch.column("key"))
            n_words, n_removed, kept = [], [], []
            for text, at, all_ in zip(texts_of(batch.column("text")), starts, whole, strict=True):
                words = text.split()
                left = words
                if all_ and len(words) >= WINDOW:
                    left = []
                elif at:
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, np.array(at), 1)
                    np.add.at(change, np.array(at) + WINDOW, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


class Copies:
    """Documents whose whole text is that of a smaller doc_id: all their windows start there.

    ``table`` has their (doc_id, text_hash) and ``maybe`` passes them. ``wrong`` passes the others that ``maybe``
    passes too, and is None if there are none: then no text need be shuffled to tell copies from the rest.
    """

    def __init__(self, docs: DataFrame):
        keys = settle(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(7), "text").alias("second")))
        first = (keys.groupBy("text_hash", "second")
                 .agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
        self.table = settle(keys.join(first, ["text_hash", "second"])
                            .where("doc_id > first OR doc_id IS NULL").select("doc_id", "text_hash").distinct())
        self.maybe = KeyFilter(self.table, "doc_id", "text_hash")
        passed = keys.where(self.maybe.passes("doc_id", "text_hash")).alias("d")
        odd = settle(passed.join(self.table.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.text_hash = c.text_hash"), "left_anti"))
        self.wrong = None if odd.isEmpty() else KeyFilter(odd, "doc_id", "text_hash")

    def unsure(self, texts: DataFrame) -> DataFrame:
        """Rows of ``texts`` that pass both filters, with ``whole``: whether they are copies."""
        some = texts.where(self.maybe.passes("doc_id", "text_hash") & self.wrong.passes("doc_id", "text_hash")).alias("d")
        flags = self.table.withColumn("whole", F.lit(True)).alias("c")
        return (some.join(flags, F.expr("d.doc_id <=> c.doc_id AND d.text_hash = c.text_hash"), "left")
                .select("d.*", F.coalesce("whole", F.lit(False)).alias("whole")))

    def others(self, texts: DataFrame, work, schema: str) -> DataFrame:
        """``work(skip)`` over the rows of ``texts`` that are no copies; rows that pass the filter ``skip`` are left out there."""
        out = texts.mapInArrow(work(self.maybe), schema)
        return out if self.wrong is None else out.union(self.unsure(texts).where(~F.col("whole")).mapInArrow(work(None), schema))


def _keyed(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return texts.withColumn("key", F.xxhash64("doc_id", "text_hash"))


def repeated_starts(docs: DataFrame, copies: Copies, shared_bits: int = SHARED_BITS) -> DataFrame:
    """(doc_id, text_hash, starts): where windows begin that also start in a document with a smaller doc_id.

    Later copies of a whole text are left out: their answer is known and their first copy stands for them.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits, texts = sketch_bits(total), _keyed(docs)
    sketches = copies.others(texts, lambda skip: _sketched(bits, skip), "part long, filled binary")
    schema = "one long, two int, doc_id long, text_hash long, at int"
    if 2 * 2 ** bits <= shared_bits:
        sketch = MergedSketch(sketches, bits)
        windows = settle(copies.others(texts, lambda skip: _candidates(sketch, skip), schema))
        sketch.release()
    else:
        reached = settle(sketches.groupBy("part").applyInArrow(_reached, "row int, counter long"))
        cells = copies.others(texts, lambda skip: _cells(bits, skip), "doc_id long, text_hash long, cell long, counter0 long, counter1 long")
        for row in range(2):
            cells = cells.join(reached.where(f"row = {row}").select(F.col("counter").alias(f"counter{row}")), f"counter{row}", "left_semi")
        flagged = settle(cells.groupBy("doc_id", "text_hash").agg(F.collect_set("cell").alias("cells")))
        some = KeyFilter(flagged, "doc_id", "text_hash")
        met = texts.where(some.passes("doc_id", "text_hash")).alias("d").join(
            flagged.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash"))
        windows = settle(met.select("d.doc_id", "d.text_hash", "text", "cells").mapInArrow(_candidates(None, None), schema))
    named = F.coalesce("doc_id", F.lit(2 ** 63 - 1))
    first = settle(windows.groupBy("one", "two").agg(F.min(named).alias("first"), F.max(named).alias("last"))
                   .where("first < last").select("one", "two", "first"))
    again = KeyFilter(first, "one")
    return (windows.where(again.passes("one")).join(first, ["one", "two"]).where(named > F.col("first"))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts")))


def drop_repeats(docs: DataFrame, shared_bits: int = SHARED_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of ``docs``.

    Removed is each word covered by a window whose word sequence also starts in a document with a smaller doc_id.
    Words are kept as they are, joined by one space. A null or empty text has no words; a text of any length is worked on
    as a whole. A null doc_id counts as larger than any id, so it takes nothing from others and nulls take nothing from
    each other; rows with equal doc_id take nothing from each other either. Other columns of ``docs`` are not looked at,
    whatever their names. An empty table gives no rows.
    """
    copies = Copies(docs)
    with settled_tables(docs.sparkSession):
        found = settle(repeated_starts(docs, copies, shared_bits), outer=True)
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    some, texts = KeyFilter(found, "doc_id", "text_hash"), _keyed(docs)
    joined = F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash")
    met = some.passes("doc_id", "text_hash")
    if copies.wrong is None:
        starts = texts.where(met).alias("d").join(found.alias("f"), joined, "left").select("d.*", "starts")
        return texts.mapInArrow(_cut(copies.maybe, some), schema).union(starts.mapInArrow(_cut(copies.maybe, None), schema))
    sure = texts.where(~copies.wrong.passes("doc_id", "text_hash"))
    odd = texts.where(copies.wrong.passes("doc_id", "text_hash") & ~copies.maybe.passes("doc_id", "text_hash"))
    odd = odd.withColumn("whole", F.lit(False)).union(copies.unsure(texts))
    clean = sure.mapInArrow(_cut(copies.maybe, some), schema)
    starts = sure.where(met).alias("d").join(found.alias("f"), joined, "left").select("d.*", "starts")
    rest = odd.alias("d").join(found.alias("f"), joined, "left").select("d.*", "starts")
    return clean.union(starts.mapInArrow(_cut(copies.maybe, None), schema)).union(rest.mapInArrow(_cut(None, None), schema))
