"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes partitions, splits skewed join partitions and turns a
# join into a broadcast only after it has measured the side.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # call-site capture costs several JVM round trips for every Column built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "slowtrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def provide_shared_dir(spark: SparkSession, folder: str | None = None) -> None:
    """Name a shared folder for a session that has none.

    For programs that own their session (the entry file, the bench, tests); the library itself never makes one up.
    A folder of this machine will do only where driver and executors are one process.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="slowtrace-")
    spark.conf.set("spark.checkpoint.dir", folder)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it names it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# of each thread its own: what another thread settles meanwhile is not ours to delete
_OWNERS: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


@contextmanager
def settled_tables(spark: SparkSession) -> Iterator[None]:
    """Owns the tables settled inside the block and deletes them at its end, when results have been written."""
    owned: list[str] = []
    outer = _OWNERS.get()
    _OWNERS.set((*outer, owned))
    try:
        yield
    finally:
        _OWNERS.set(outer)
        for path in owned:
            delete_folder(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside the block the files of a shuffle go when the query that made them ends, not when the driver collects its garbage.

    For steps that settle what they have found, so that no later query reads a shuffle of an earlier one.
    """
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def settled_path(df: DataFrame, outer: bool = False) -> str:
    """Where :func:`settle` has written ``df``: several such tables of one schema can be read by one scan."""
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    owners = _OWNERS.get()
    if len(owners) > outer:
        owners[-1 - outer].append(path)
    df.write.parquet(path)
    return path


def settle(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` once, as a table in the shared folder, and go on from there.

    Used where a plan would otherwise be recomputed by several branches, and once per
    round of an iterative job. The copy survives the loss of executors, is read by
    column, and its size is known to the planner: a small one is broadcast and spares
    the other side of a join its shuffle. It stays until the enclosing :func:`settled_tables` block ends
    (``outer``: the block around that one, for the result of a step that is left).
    """
    return df.sparkSession.read.schema(df.schema).parquet(settled_path(df, outer))
