"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by size, each class twice as large as the one before. For a class of at most s shingles a document
is read in windows of 1.5 s shingles, one every s / 2, so an item of the class lies inside one of them, however long
the document is. If an item is contained to THRESHOLD, its Jaccard similarity with that window is 0.23 at least; item and
window then agree in one of COORDINATES MinHash values but for four cases in a million. The minima of the larger
windows are made of those of the smaller. Items met that way are verified by exact containment in the shingle set of the
whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtrace.llm.key_filter import without
from slowtrace.llm.words import WordHasher, mix, runs, shingle_set, texts_of
from slowtrace.session import settle

SHINGLE = 5
THRESHOLD = 0.75
COORDINATES = 48
ITEM_BYTES = 16 << 20  # text of the items that are searched for in one pass over the documents

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TIMES = ((_SEEDS[:COORDINATES] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
_PLUS = (_SEEDS[COORDINATES:] >> np.uint64(32)).astype(np.uint32)
_LEAST, _STRETCH, _TABLE_BITS = 16, 8192, 20


def class_size(n: int) -> int:
    """The largest size in the class of ``n``."""
    size = _LEAST
    while size < n:
        size *= 2
    return size


def _values(shingles: np.ndarray) -> np.ndarray:
    """Each shingle (rows) under each hash function (columns)."""
    return (shingles >> np.uint64(32)).astype(np.uint32)[:, None] * _TIMES + _PLUS


def _joined(blocks: np.ndarray) -> np.ndarray:
    """Minima of blocks of twice the size."""
    if len(blocks) % 2:
        blocks = np.concatenate([blocks, blocks[-1:]])
    return np.minimum(blocks[0::2], blocks[1::2])


class _Postings:
    """Items by (coordinate, value); a small table tells most values that no item has."""

    def __init__(self, rows: list[tuple[np.ndarray, int]]):
        keys = np.concatenate([k for k, _ in rows])
        places = np.concatenate([np.full(len(k), p) for k, p in rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)

    def met(self, keys: np.ndarray) -> set[int]:
        keys = np.unique(keys)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        return {int(p) for a, b in zip(low, high, strict=True) for p in self.places[a:b]}

    def met_by(self, minima: np.ndarray) -> set[int]:
        row, coordinate = np.nonzero(self.table[self._slot(minima)])
        return self.met(_keys(minima[row, coordinate], coordinate)) if len(row) else set()


def _keys(values: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    return coordinates.astype(np.uint64) << np.uint64(32) | values.astype(np.uint64)


class Items:
    """A bounded set of items, ready for search: postings per class, and the sets for verification."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        hasher = WordHasher()
        self.ids, self.sets = [], []
        classes: dict[int, list[tuple[np.ndarray, int]]] = {}
        direct: list[tuple[np.ndarray, int]] = []
        for item_id, text in rows:
            hashes = hasher(text.lower().split())
            found, place = shingle_set(hashes, SHINGLE), len(self.ids)
            if not len(found):
                continue
            self.ids.append(item_id)
            self.sets.append(found)
            length = max(len(hashes) - SHINGLE + 1, 0)
            if len(found) < max(_LEAST // 2, 0.9 * length):
                # very small, or repeating itself: too little for MinHash, so each shingle is a posting
                direct.append((found, place))
            else:
                classes.setdefault(class_size(length), []).append(
                    (_keys(_values(found).min(axis=0), np.arange(COORDINATES)), place))
        self.classes = {size: _Postings(classes[size]) for size in sorted(classes)}
        self.direct = _Postings(direct) if direct else None

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that agree with a window of ``shingles`` (in order) or share a shingle that is a posting."""
        met: set[int] = set()
        if self.direct:
            met |= self.direct.met(shingles)
        reach = max(self.classes, default=0)
        for at in range(0, len(shingles) if self.classes else 0, _STRETCH):
            # long documents in stretches, each with the longest item that reaches into the next
            part = shingles[at:at + _STRETCH + reach]
            size = _LEAST
            part = np.concatenate([part, np.full(-len(part) % (size // 2), part[-1])])
            blocks = _values(part).reshape(-1, size // 2, COORDINATES).min(axis=1)
            for wanted, postings in self.classes.items():
                while size < wanted:
                    blocks, size = _joined(blocks), 2 * size
                if len(blocks) > 2:
                    minima = np.minimum(np.minimum(blocks[:-2], blocks[1:-1]), blocks[2:])
                else:
                    minima = blocks.min(axis=0, keepdims=True)
                met |= postings.met_by(minima)
        return met


def _searched(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = WordHasher(), shared.value
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(texts_of(batch.column("text"))):
                hashes = hasher(text.lower().split())
                # of a document with fewer words, the one shingle it counts as
                in_order = runs(hashes, SHINGLE) if len(hashes) >= SHINGLE else shingle_set(hashes, SHINGLE)
                places = items.candidates(in_order)
                found = np.unique(in_order) if places else in_order
                for place in sorted(places):
                    own = items.sets[place]
                    common = int(np.isin(own, found, assume_unique=True).sum())
                    if common >= threshold * len(own):
                        rows.append((i, items.ids[place], len(own), common))
            if rows:
                owner, item, size, common = zip(*rows, strict=True)
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(owner), batch.column("text_hash").take(owner),
                    pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(common, pa.int64()),
                ], ["doc_id", "text_hash", "item_id", "n_shingles", "n_found"])
    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_found): items of which a document holds ``threshold`` or more.

    Words are lower-cased in A-Z; shingles are five words, an item or document with fewer words is one shingle. Null and
    empty texts hold nothing and are found nowhere. Repeated rows on either side give repeated pairs, null ids are
    handed through. Items are searched in blocks of ITEM_BYTES of text, one pass over the documents each, so what is sent
    to the tasks does not grow with their number; each item's text must fit a task.
    """
    spark = docs.sparkSession
    schema = "doc_id long, text_hash long, item_id long, n_shingles long, n_found long"
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own = items.select("item_id", "text").where("text IS NOT NULL")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = ceil(total / ITEM_BYTES)
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"].encode()) for r in rows]))
        hits = texts.mapInArrow(_searched(shared, threshold), schema)
        found = hits if block == 0 else found.union(hits)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns as they were."""
    gone = settle(contained_items(docs, items, threshold).select("doc_id", "text_hash").distinct())
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    return without(marked, gone.withColumnRenamed("text_hash", "__hash"), "doc_id", "__hash").drop("__hash")
