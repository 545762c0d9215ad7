"""Micro-batches of completions and late slices, folded into one table as they come.

Each micro-batch adds its completions and its late slices as parts of their own (:mod:`slowtrace.sources.versions`).
Every few batches the days that have late slices are folded: their parts are merged into one new part each, and one
commit puts it in the place of all of them. So what a reader has to merge stays bounded by the batches since the last
fold, a reader sees a day before or after its fold and never in between, and a batch that runs again counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slowtrace.operators.accounting import merge_pending
from slowtrace.sources.versions import Conflict, Part, Version, Versions

BASE, STAGED = "base", "staged"


@dataclass(frozen=True)
class FoldedTable:
    """A bucket table below ``path``: ``schema`` with ``keys`` (the bucket among them), split by ``day`` of the bucket."""
    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    day: int
    bucket: str = "bucket"

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.path)

    @property
    def _staging_schema(self) -> StructType:
        return StructType([*[self.schema[k] for k in self.keys], StructField("additional_time", LongType())])

    def _split(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("split", F.call_function("div", F.col(self.bucket), F.lit(self.day).cast("bigint")))

    def add(self, completions: DataFrame, slices: DataFrame, writer: str, batch: int) -> Version:
        """Add one batch; added again, it changes nothing.

        ``slices`` are the keys with ``additional_time``; several rows may have one key.
        """
        versions = self.versions
        now = versions.read()
        if now.done.get(writer, -1) >= batch:
            return now
        late = slices.groupBy(*self.keys).agg(F.sum("additional_time").alias("additional_time"))
        parts = versions.write_parts(self._split(completions.select(*self.schema.names)), BASE, "split")
        parts |= versions.write_parts(self._split(late), STAGED, "split")
        return versions.commit(lambda _: (parts, set()), writer, batch)

    def _merged(self, version: Version, splits: set[str] | None = None) -> DataFrame:
        versions = self.versions
        base = versions.rows(version.of(BASE, splits), self.schema)
        staged = versions.rows(version.of(STAGED, splits), self._staging_schema)
        return merge_pending(base, staged, self.keys)

    def read(self, number: int | None = None) -> DataFrame:
        """The table with everything added up to a version, one row per key."""
        return self._merged(self.versions.read(number))

    def fold(self) -> Version:
        """Merge the days that have late slices or several parts, and commit the result in place of their parts.

        Parts added meanwhile stay as they are. If another fold was faster, nothing is changed.
        """
        versions = self.versions
        now = versions.read()
        splits = [p.split for p in now.of(BASE)]
        touched = {p.split for p in now.of(STAGED)} | {s for s in splits if splits.count(s) > 1}
        if not touched:
            return now
        folded = versions.write_parts(self._split(self._merged(now, touched)), BASE, "split")
        old: set[Part] = {*now.of(BASE, touched), *now.of(STAGED, touched)}
        try:
            return versions.commit(lambda _: (folded, old))
        except Conflict:
            return versions.read()


def fold_batches(
    table: FoldedTable, completions: Callable[[DataFrame], DataFrame], slices: Callable[[DataFrame], DataFrame],
    every: int = 8, writer: str = "stream", keep: int = 2,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: add what each micro-batch of calls gives, and fold after ``every`` of them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(completions(batch), slices(batch), writer, batch_id)
        if batch_id % every == every - 1:
            table.fold()
            table.versions.forget(keep)

    return write
