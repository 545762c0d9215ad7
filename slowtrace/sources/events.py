"""Event logs as batch and streaming sources, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_events_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """A stream over a growing folder of files, or any other source format (``kafka``)."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load() if fmt == "kafka" else reader.load(path)
