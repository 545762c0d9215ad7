"""Metric scrapes in the text exposition format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The sample names a scrape is reduced to.
EVENT_COUNTER = "experiment_producer_event_count"
EXPERIMENT_GAUGE = "experiment_producer_num_experiments"


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Scrape files as ``scrape, line_no, line``; a file is one scrape.

    ``line_no`` orders the lines of a file: the split they are in, then their place there.
    """
    return spark.read.schema("value string").text(path).select(
        F.col("_metadata.file_path").alias("scrape"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place")).alias("line_no"),
        F.col("value").alias("line"),
    )


def parse_scrapes(
    lines: DataFrame,
    scrape: str = "scrape",
    line_no: str = "line_no",
    line: str = "line",
    counter: str = EVENT_COUNTER,
    gauge: str = EXPERIMENT_GAUGE,
) -> DataFrame:
    """Per scrape: the sum of all counter samples and the last gauge sample.

    Comment lines do not count. Labels are part of the name, which is matched by prefix;
    the value is the second blank-separated field.
    """
    name = F.split_part(F.col(line), F.lit(" "), F.lit(1))
    number = F.split_part(F.col(line), F.lit(" "), F.lit(2)).cast("bigint")
    is_counter, is_gauge = name.startswith(counter), name.startswith(gauge)
    samples = lines.filter(~F.col(line).startswith("#")).filter(is_counter | is_gauge)
    zero = F.lit(0).cast("bigint")
    return samples.groupBy(scrape).agg(
        F.coalesce(F.sum(F.when(is_counter, number)), zero).alias("total_events"),
        F.coalesce(F.max_by(number, F.when(is_gauge, F.col(line_no))), zero).alias("current_experiments"),
    )
