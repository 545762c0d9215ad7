"""Scanning a tree of metric CSV files into the long model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slowtrace.functions.labels import series_id
from slowtrace.functions.timebase import floor_div

# The file layouts, as (class, scope, pattern, what the groups mean).
LAYOUT_V2 = [
    ("schedstat", "thread", r"system-metrics/thread/(\d+)/(\d+)/schedstat/(\d+)\.csv$",
     ("pid", "tid", "part_seq")),
    ("sched", "thread", r"system-metrics/thread/(\d+)/(\d+)/sched/(\d+)\.csv$",
     ("pid", "tid", "part_seq")),
    ("futex", "thread", r"system-metrics/thread/(\d+)/(\d+)/futex/(\w+)/(\d+)/([\w-]+)\.csv$",
     ("pid", "tid", "ipc_type", "part_seq", "resource")),
    ("ipc", "thread", r"system-metrics/thread/(\d+)/(\d+)/ipc/(\w+)/(\d+)/(.*)\.csv$",
     ("pid", "tid", "ipc_type", "part_seq", "resource")),
    ("global_iowait", "global", r"system-metrics/global/iowait/(\d+)/(\d+)/(\d+)/(\d+)\.csv$",
     ("pid", "tid", "part_seq", "resource")),
    ("global_epoll", "global", r"system-metrics/global/epoll/(.+?)/(\w+)/(\d+)/(.+)\.csv$",
     ("poll", "ipc_type", "part_seq", "resource")),
]
LAYOUT_V1 = [
    ("global_iowait", "global", r"system-metrics/iowait/(.+?)/(\d+)/(\d+)/(\d+)\.csv$",
     ("comm", "tid", "part_seq", "resource")),
    ("global_epoll", "global", r"system-metrics/epoll/(.+?)/(\w+)/(\d+)/(.+)\.csv$",
     ("poll", "ipc_type", "part_seq", "resource")),
    ("schedstat", "thread", r"system-metrics/(.+?)/(\d+)/schedstat/(\d+)\.csv$",
     ("comm", "tid", "part_seq")),
    ("sched", "thread", r"system-metrics/(.+?)/(\d+)/sched/(\d+)\.csv$",
     ("comm", "tid", "part_seq")),
    ("futex", "thread", r"system-metrics/(.+?)/(\d+)/futex/(\d+)\.csv$",
     ("comm", "tid", "part_seq")),
    ("ipc", "thread", r"system-metrics/(.+?)/(\d+)/ipc/(\w+)/(\d+)/(.*)\.csv$",
     ("comm", "tid", "ipc_type", "part_seq", "resource")),
]
LAYOUTS = {"v2": LAYOUT_V2, "v1": LAYOUT_V1}

# File names hold endpoints (``10.0.0.1:80``); the checksummed local file system cannot
# open a name with a colon, the raw one can. Object stores are not affected.
_COLONS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}

_SEPARATOR = "\u0001"
_TIME_COLUMNS = ("epoch_s", "epoch_ms")
_DIMENSIONS = {
    "scope": "string", "pid": "bigint", "tid": "bigint", "comm": "string", "metric_class": "string",
    "ipc_type": "string", "resource": "string", "part_seq": "bigint",
}


# a comma outside quotes; a quoted cell may hold commas, and "" for a quote
_CELL_END = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """The cells of a CSV line, trimmed and without their quotes."""
    def plain(cell: Column) -> Column:
        trimmed = F.trim(cell)
        quoted = trimmed.rlike('^".*"$')
        return F.when(quoted, F.replace(F.regexp_replace(trimmed, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(trimmed)

    return F.transform(F.split(line, _CELL_END, -1), plain)


def _lines(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the value lines, and one header row per file, of all files below ``root``.

    The header is the line that names the time column. A file that has none fails the job.
    """
    lines = (
        spark.read.schema("value string")
        .option("recursiveFileLookup", "true")
        .options(pathGlobFilter=glob, **_COLONS)
        .text(root)
        .select(F.col("_metadata.file_path").alias("file_path"), F.trim("value").alias("line"))
        .filter(F.col("line") != "")
    )
    cells = lines.select("file_path", _cells(F.col("line")).alias("cells"))
    is_header = F.arrays_overlap("cells", F.array(*[F.lit(c) for c in _TIME_COLUMNS]))
    missing = F.raise_error(F.concat(F.lit("metric file without a header: "), "file_path"))
    headers = (
        cells.groupBy("file_path")
        .agg(F.min(F.when(is_header, F.col("cells"))).alias("names"))
        .withColumn("names", F.coalesce("names", missing.cast("array<string>")))
    )
    return cells.filter(~is_header), headers


def _samples(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines cut by their file's header; further columns of ``files`` are kept."""
    kept = [c for c in files.columns if c != "names"]
    # a short line lacks its last values, a long one has cells without a name
    named = F.transform("names", lambda name, i: F.get("cells", i))
    row = lines.join(files, ["file_path"]).select(*kept, F.map_from_arrays("names", named).alias("row"))

    def number(name: str) -> Column:
        return F.expr(f"try_cast(try_cast(row['{name}'] as double) as bigint)")

    timed = row.select(*kept, number("epoch_s").alias("s"), number("epoch_ms").alias("epoch_ms"), "row")
    return (
        timed.select(
            *kept,
            F.coalesce("s", floor_div(F.col("epoch_ms"), 1000)).alias("epoch_s"),
            "epoch_ms",
            F.explode("row").alias("metric", "text"),
        )
        .filter(~F.col("metric").isin(*_TIME_COLUMNS))
        # a missing number is NULL from here on, never NaN
        .withColumn("value", F.expr("nullif(try_cast(text as double), double('NaN'))"))
        .drop("text")
    )


def scan_metric_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """All CSV files below ``root`` as ``file_path, epoch_s, epoch_ms, metric, value``.

    The columns of a file follow from its own header, because every metric class has its
    own. Lines are read as splittable text and meet their file's header by path; headers
    are one row per file. ``epoch_s`` is derived where a file has only milliseconds.
    """
    return _samples(*_lines(spark, root, glob))


def scan_metric_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Files of one class with a known column order, read by explicit schema."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("recursiveFileLookup", "true")
        .options(**_COLONS)
        .csv(root)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


def parse_metric_path(
    df: DataFrame, layout: str = "v2", on_error: str = "raise", path: str = "file_path"
) -> DataFrame:
    """Adds the series dimensions a file path stands for.

    ``on_error``: ``raise`` fails the job on a path that fits no layout, ``skip`` drops
    its rows, ``keep`` leaves them with empty dimensions and ``malformed`` set.
    """
    col = F.col(path)

    def fields(metric_class: str, scope: str, groups: tuple[str, ...]) -> str:
        """All dimensions of a class in fixed order, as a replacement for its pattern."""
        place = {name: f"${i + 1}" for i, name in enumerate(groups)}
        if "poll" in place:
            # an epoll series is named by its set and the file behind it
            place["resource"] = f"{place['poll']}/{place['resource']}"
        place |= {"metric_class": metric_class, "scope": scope}
        return _SEPARATOR.join(place.get(name, "") for name in _DIMENSIONS)

    # one test per class until the first hit, then one replacement yields every dimension
    taken = F.coalesce(*[
        F.when(col.rlike(pattern), F.regexp_replace(col, "^.*?" + pattern, fields(metric_class, scope, groups)))
        for metric_class, scope, pattern, groups in LAYOUTS[layout]
    ])
    split = df.withColumn("__fields", F.split(taken, _SEPARATOR))
    dims = {
        name: F.nullif(F.col("__fields")[i], F.lit("")).cast(kind)
        for i, (name, kind) in enumerate(_DIMENSIONS.items())
    }
    parsed = split.withColumns(dims).drop("__fields")
    malformed = F.col("metric_class").isNull()
    if on_error == "raise":
        message = F.concat(F.lit("unexpected metric file path: "), col)
        checked = F.when(malformed, F.raise_error(message)).otherwise(F.col("metric_class"))
        return parsed.withColumn("metric_class", checked)
    if on_error == "skip":
        return parsed.filter(~malformed)
    return parsed.withColumn("malformed", malformed)


def metric_points(
    spark: SparkSession, root: str, layout: str = "v2", on_error: str = "raise", run_id: str | None = None
) -> DataFrame:
    """A metric tree as ``metric_points`` rows with their ``series_id``.

    Paths are parsed once per file, on the header side, not once per sample.
    """
    lines, headers = _lines(spark, root, "*.csv")
    parsed = _samples(lines, parse_metric_path(headers, layout, on_error))
    return parsed.withColumn("run_id", F.lit(run_id).cast("string")).withColumn("series_id", series_id())
