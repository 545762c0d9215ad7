"""Near-duplicate documents by an inverted join over signature coordinates.

Documents with equal shingle sets are one node. Each node is posted under its pairs (coordinate, value). Two sets of
similarity s agree in about s * COORDINATES places; a pair is retained if it agrees in MATCHES at least. Such a pair
must meet under one of the COORDINATES - MATCHES + 1 rarest postings of each node, so only these prefix lists are
merged; the long lists are skipped and looked up in the signatures of the pairs found. Pairs above the threshold are
confirmed on the full sets. A list that stays long although its nodes are in many groups (documents around one template)
is taken apart by the rarest shingles of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slowtrace.llm.key_filter import KeyFilter, without
from slowtrace.llm.linking import linked_groups, shared_postings
from slowtrace.llm.words import WordHasher, mix, shingle_set, texts_of
from slowtrace.session import settle, settled_tables

SHINGLE = 5
COORDINATES = 48
# a pair of similarity 0.75 agrees in fewer places with a probability below one in a million
MATCHES = 21

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = (_SEEDS[:COORDINATES] | np.uint64(1))[:, None], _SEEDS[COORDINATES:][:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of the set under each of COORDINATES hash functions, 31 bits of it."""
    lowest = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(lowest, (_TIMES * shingles[None, at:at + 4096] + _PLUS).min(axis=1), out=lowest)
    return (mix(lowest) >> np.uint64(33)).astype(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in texts_of(batch.column(2)):
            shingles = shingle_set(hasher(text.lower().split()), SHINGLE)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            signatures.append(signature(shingles))
        flat = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
        offsets = np.arange(len(sizes) + 1, dtype=np.int32) * COORDINATES
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
        ], ["doc_id", "text_hash", "n_shingles", "digest", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        sets = [shingle_set(hasher(text.lower().split()), SHINGLE).view(np.int64) for text in texts_of(batch.column(1))]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])


def prefix_postings(nodes: DataFrame) -> DataFrame:
    """(key, node, rank, n_shingles, signature) under the rarest postings of each node that can decide a pair.

    A posting that no other node has decides nothing, but counts as the rarest. Lowest in ``rank`` are nodes whose
    values are the most frequent: copies that were edited least lie in the middle of their group.
    """
    every = nodes.select("node", F.posexplode("signature").alias("at", "value")).select(
        (F.shiftleft(F.col("value").cast("long"), 8) + F.col("at")).alias("key"), "node")
    mine = Window.partitionBy("node")
    kept = (shared_postings(every).withColumns({"met": F.count("*").over(mine), "rank": -F.sum("n").over(mine)})
            .where(f"met >= {MATCHES}").withColumn("place", F.row_number().over(mine.orderBy("n", "key")))
            .where(f"place <= met - {MATCHES} + 1"))
    return kept.select("key", "node", "rank").join(nodes.select("node", "n_shingles", "signature"), "node")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(key, node, rank) of ``sets`` (node, shingles): the rarest shingles of each set, under which all linked sets meet.

    Linked sets share three quarters of either, so the rarest of their common shingles is among the rarest quarter of
    both. A shingle that no other set has meets nobody, but counts as the rarest.
    """
    every = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("node")
    return (every.join(shared, "key").withColumns({"met": F.count("*").over(mine), "rank": -F.sum("n").over(mine)})
            .where("4 * met >= 3 * size").withColumn("place", F.row_number().over(mine.orderBy("n", "key")))
            .where("place <= met - (3 * size + 3) div 4 + 1").select("key", "node", "rank"))


def _close(left: str, right: str) -> Column:
    """May two nodes be similar, by sizes and signatures?"""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    agree = F.aggregate(F.zip_with(F.col(f"{left}.signature"), F.col(f"{right}.signature"),
                                   lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return (4 * a >= 3 * b) & (4 * b >= 3 * a) & (agree >= MATCHES)


def _similar_sets(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Which sets of two blocks are linked, counted on the shingles that both blocks have."""
    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = table["shingles"].combine_chunks()
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        return pc.list_flatten(column).to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes

    (x, x_owner, x_size), (y, y_owner, y_size) = flat(left), flat(right)
    common = np.intersect1d(x, y)
    both = np.zeros((len(x_size), len(y_size)), np.float32)
    for at in range(0, len(common), 4096):
        part = common[at:at + 4096]
        sides = []
        for values, owner, n in ((x, x_owner, len(x_size)), (y, y_owner, len(y_size))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            side = np.zeros((n, len(part)), np.float32)
            side[owner[hit], place[hit]] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return 100 * both >= 75 * (x_size[:, None] + y_size[None, :] - both)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row of ``docs``.

    Words are lower-cased in A-Z; a set holds the distinct runs of five words, of a shorter text the whole sequence.
    Documents are linked if ``100 * intersection >= 75 * union``; ``component_id`` is the smallest doc_id that can be
    reached. Texts without words are linked with nothing. A null doc_id is larger than any id: its row is kept only
    where the whole component has no id. Rows with one doc_id share its verdict. An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = settle(texts.mapInArrow(_signed, "doc_id long, text_hash long, n_shingles long, digest binary, signature array<int>"))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count("*").alias("n"))
    nodes = settle(classes.select("digest", "n", "n_shingles", "signature", "first.doc_id", "first.text_hash",
                                  F.monotonically_increasing_id().alias("node")))

    met = settle(prefix_postings(nodes))
    wanted = nodes.select("node", "doc_id", "text_hash").join(met.select("node").distinct(), "node")
    some = KeyFilter(wanted, "doc_id", "text_hash")
    found = texts.where(some.passes("doc_id", "text_hash")).alias("d").join(
        wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id AND d.text_hash = w.text_hash"))
    # rows that repeat id and text give a node twice
    sets = settle(found.select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets, "node long, shingles array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return (pairs.join(one, "a").join(two, "b")
                .where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b"))

    groups = linked_groups(met, _close, verify, lambda _: sets, _similar_sets,
                           finer=lambda some: rare_shingles(sets.join(some, "node")))
    grouped = nodes.select("digest", "node", "doc_id", "n").join(groups, "node", "left")
    named = grouped.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("n"))
    # a class of one document that is linked with nothing answers for itself
    answers = settle(named.join(smallest.where("n > 1").drop("n"), "component").select("digest", "component_id"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(
        answers.withColumn("grouped", F.lit(True)), "digest", "left")
    component = F.when(F.col("grouped") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.withColumn("component_id", component)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "text_hash", "n_shingles", "component_id", "kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the smallest of their group; all columns as they were."""
    with settled_tables(docs.sparkSession):
        gone = settle(near_groups(docs).where("NOT kept").select("doc_id", "text_hash").distinct(), outer=True)
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    return without(marked, gone.withColumnRenamed("text_hash", "__hash"), "doc_id", "__hash").drop("__hash")
