"""The metric store: typed tables as Parquet, partitioned by run, day and write.

Every write is a part of its own inside the day's folder, so a merge can replace exactly the parts it has read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from slowtrace.operators.accounting import merge_pending
from slowtrace.operators.shares import taskstats_view
from slowtrace.schemas import MERGE_KEYS, TABLES
from slowtrace.session import delete_folder, file_system, folder_exists

_TIME = ("ts", "ts_s")
_PART = "part"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns and types; columns the frame lacks are NULL."""
    fields = TABLES[table].fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ])


def _parts(spark: SparkSession, path: str, table: str, part: str = "*") -> list[str]:
    """Folders ``run_id=…/day=…/part=…`` of a table: one per write and day."""
    fs, pattern = file_system(spark, f"{path}/{table}/run_id=*/day=*/{_PART}={part}")
    found = fs.globStatus(pattern)
    return ["/".join(f.getPath().toString().split("/")[-3:]) for f in found or []]


def _day_of(part: str) -> str:
    return part.rsplit("/", 1)[0]


def _delete_parts(spark: SparkSession, path: str, table: str, parts: Iterable[str]) -> None:
    for part in parts:
        delete_folder(spark, f"{path}/{table}/{part}")


def _write_part(df: DataFrame, path: str, table: str, part: str) -> None:
    """Write ``df`` (with run_id and day) as one part; the same part written again is replaced.

    Rows are rebalanced by day before the write: adaptive execution splits a big day and
    merges small ones, so files have a sane size and no day is one task.
    """
    (
        df.withColumn(_PART, F.lit(part))
        .hint("rebalance", "run_id", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "day", _PART)
        .parquet(f"{path}/{table}")
    )


def write_table(df: DataFrame, path: str, table: str, run_id: str, mode: str = "append") -> None:
    """Append one table of a run (or replace the run's days it touches with ``overwrite``)."""
    typed = conform(df, table)
    time = next((c for c in _TIME if c in typed.columns), None)
    day = F.to_date(F.col(time)) if time else F.lit(None).cast("date")
    dated = typed.withColumn("run_id", F.lit(run_id)).withColumn("day", F.coalesce(day.cast("string"), F.lit("none")))
    spark, part = df.sparkSession, uuid.uuid4().hex
    before = _parts(spark, path, table) if mode == "overwrite" else []
    _write_part(dated, path, table, part)
    if before:
        touched = {_day_of(p) for p in _parts(spark, path, table, part)}
        _delete_parts(spark, path, table, [p for p in before if _day_of(p) in touched])


def write_store(tables: Mapping[str, DataFrame], path: str, run_id: str, mode: str = "append") -> None:
    for name, df in tables.items():
        write_table(df, path, name, run_id, mode)


def _partitioned(table: str) -> T.StructType:
    parts = [T.StructField(name, T.StringType()) for name in ("run_id", "day", _PART)]
    return T.StructType([*TABLES[table].fields, *parts])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table with its run and day; filters on them prune folders. One never written has no rows."""
    if not folder_exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], _partitioned(table)).drop(_PART)
    return spark.read.schema(_partitioned(table)).parquet(f"{path}/{table}").drop(_PART)


def _read_parts(spark: SparkSession, path: str, table: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], _partitioned(table)).drop(_PART)
    folder = f"{path}/{table}"
    reader = spark.read.schema(_partitioned(table)).option("basePath", folder)
    return reader.parquet(*[f"{folder}/{part}" for part in parts]).drop(_PART)


def register_views(
    spark: SparkSession, path: str, tables: list[str] | None = None, run_id: str | None = None
) -> list[str]:
    """The store as temporary views, ready for ``spark.sql``.

    ``taskstats_view`` comes on top of ``taskstats``.
    """
    names = list(tables or (t for t in TABLES if not t.endswith("_staging")))
    registered = []
    for name in names:
        df = read_table(spark, path, name)
        if run_id is not None:
            df = df.filter(F.col("run_id") == run_id)
        df.createOrReplaceTempView(name)
        registered.append(name)
        if name == "taskstats":
            taskstats_view(df, keys=("run_id", "tid")).createOrReplaceTempView("taskstats_view")
            registered.append("taskstats_view")
    return registered


_FOLDED = "merge string, table string, part string"


def merge_staged(spark: SparkSession, path: str, table: str, into: str) -> None:
    """Fold the parts that ``<table>_staging`` holds now into the days they touch and write those below ``into``.

    Only parts of touched days are read, and their names are kept beside the result. The
    store itself stays as it is; ``publish_merged`` puts the result in.
    """
    staged = _parts(spark, path, f"{table}_staging")
    touched = {_day_of(p) for p in staged}
    base = [p for p in _parts(spark, path, table) if _day_of(p) in touched]
    staging = _read_parts(spark, path, f"{table}_staging", staged)
    merged = merge_pending(_read_parts(spark, path, table, base), staging, [*MERGE_KEYS[table], "run_id", "day"])
    merged.hint("rebalance", "run_id", "day").write.mode("overwrite").partitionBy("run_id", "day").parquet(f"{into}/{table}")
    name = uuid.uuid4().hex
    folded = [(name, table, p) for p in base] + [(name, f"{table}_staging", p) for p in staged]
    spark.createDataFrame(folded, _FOLDED).write.mode("overwrite").parquet(f"{into}/{table}_folded")


def publish_merged(spark: SparkSession, path: str, table: str, merged: str) -> None:
    """Put the merged days into the store as one part, then delete exactly the parts they were made of.

    Slices staged and rows appended since ``merge_staged`` are parts of their own and stay.
    Each step can be run again after a failure without counting a slice twice; a reader
    that must not see both versions of a day waits for the end.
    """
    folded = spark.read.schema(_FOLDED).parquet(f"{merged}/{table}_folded").collect()  # one row per write and day
    if not folded:
        return
    _write_part(read_table(spark, merged, table), path, table, folded[0]["merge"])
    for name in (table, f"{table}_staging"):
        _delete_parts(spark, path, name, [f["part"] for f in folded if f["table"] == name])
