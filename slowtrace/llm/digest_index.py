"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, with one row per distinct text ever added. A batch is
reduced to one row per digest, joined to the index by sort-merge anti-join, and what is new is appended. Only the
batch is shuffled: the index is read bucket by bucket.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtrace.llm.key_filter import KeyFilter
from slowtrace.session import settle, settled_tables

_INDEX = "digest BINARY, doc_id BIGINT, row BIGINT"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text after lower-casing A-Z; a null counts as an empty text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered, 256))


class DigestIndex:
    """An index below ``path``. ``buckets`` belongs to the index and must be the same whenever it is opened."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{hashlib.sha1(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_INDEX}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the index out of the catalog; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (digest, doc_id, row) that the index lacks.

        Of equal digests in one batch the largest ``(doc_id, row)`` enters; a null doc_id is smaller than any id.
        Adding a batch again changes nothing, so a run that broke off can be repeated.
        """
        own = batch.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("stays"))
        fresh = own.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # dealt out by bucket, so that a bucket gets one file of a batch however many partitions there are
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (fresh.select("digest", "stays.doc_id", "stays.row").repartition(self.buckets, bucket)
         .sortWithinPartitions(bucket, "digest").write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def fingerprints(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """(doc_id, digest, row) of every row, settled, so that ``row`` tells equal rows apart from here on."""
    text = F.col(text) if isinstance(text, str) else text
    return settle(docs.select("doc_id", text_digest(text).alias("digest"),
                              F.monotonically_increasing_id().alias("row")))


def exact_groups(prints: DataFrame, index: DigestIndex) -> DataFrame:
    """The row of each text that stays: (doc_id, row, digest, keep_id, group_size, kept) for every row of ``prints``.

    Rows are added to the index in two batches, larger ids first, so the index holds the largest ``doc_id`` of each
    text it did not have before. Of rows that repeat both id and text exactly one is kept. A null ``doc_id`` loses
    against any id. An empty table gives an empty result. Ids may be any 64-bit integers; columns other than the
    text and doc_id are ignored, whatever their names.
    """
    # halves are added: the sum of two ids may pass 64 bits
    bounds = prints.agg(F.expr("min(doc_id) div 2 + max(doc_id) div 2")).first()
    upper = F.coalesce(F.col("doc_id") >= F.lit(bounds[0]).cast("long"), F.lit(False))
    index.add(prints.where(upper))
    index.add(prints.where(~upper))
    sizes = prints.groupBy("digest").agg(F.count("*").alias("group_size"))
    stays = index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = settle(sizes.join(stays, "digest"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return prints.join(groups, "digest").withColumn("kept", same).drop("keep_row")


def drop_exact(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` without the rows whose text stays elsewhere; all its columns as they were.

    Only rows that a filter of the dropped and repeated ones passes are matched with their list, the others stay
    where they are. Of rows that repeat both id and text one is chosen after that.
    """
    with settled_tables(docs.sparkSession):
        verdicts = exact_groups(fingerprints(docs), index)
        pairs = settle(verdicts.groupBy("doc_id", F.col("digest").alias("__digest"))
                       .agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), outer=True)
    marked = docs.withColumn("__digest", text_digest(F.col("text")))
    some = KeyFilter(pairs, "doc_id", "__digest").passes("doc_id", "__digest")
    gone = pairs.where("NOT kept").alias("g")
    met = marked.where(some).alias("m").join(gone, F.expr("m.doc_id <=> g.doc_id AND m.__digest = g.__digest"), "left_anti")
    # whatever else the filter passes is met once
    return marked.where(~some).unionByName(met.dropDuplicates(["doc_id", "__digest"])).drop("__digest")
