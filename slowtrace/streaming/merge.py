"""Micro-batch merge of late slices into a bucket table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from slowtrace.operators.accounting import merge_pending
from slowtrace.session import folder_exists


def stage_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps each micro-batch's slices apart.

    A batch replaces its own folder, so a batch that is run again after a failure does
    not count twice, and the target table is never rewritten while it is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merged(spark: SparkSession, target: DataFrame, staged_path: str, keys: Sequence[str]) -> DataFrame:
    """The target with all staged batches applied; as it is where none has come yet."""
    schema = T.StructType([*[target.schema[k] for k in keys], T.StructField("additional_time", T.LongType())])
    if folder_exists(spark, staged_path):
        staging = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(staged_path)
    else:
        staging = spark.createDataFrame([], schema)
    return merge_pending(target, staging, keys)
