"""Keyed state of a stream lies in as many partitions as the cores keep busy."""

import os

from pyspark.sql import functions as F

from helpers import rows
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import calls
from slowtrace.streaming.run import drain_stateful, state_tasks

US = 1_000_000
SCHEMA = "tid long, ts long, seq long, kind string"
PARTITIONS = "spark.sql.shuffle.partitions"


def test_partitions_follow_the_cores(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    moves = [(tid, US + tid * 1000 + end * US // 4, tid, "end" if end else "start") for tid in range(500) for end in (0, 1)]
    spark.createDataFrame([*moves, (900, 60 * US, 900, "start")], SCHEMA).write.parquet(src)
    stream = read_events_stream(spark, src, SCHEMA).withColumn("event_time", F.timestamp_micros("ts"))
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "100")
    try:
        drain_stateful(calls.streaming_slices(stream, ["tid"], "start", "end", US), calls.call_batches(out, []), ck)
        assert spark.conf.get(PARTITIONS) == "100"
        assert state_tasks(spark) == 16  # of local[8]
    finally:
        spark.conf.set(PARTITIONS, before)
    assert len([p for p in os.listdir(f"{ck}/state/0") if p.isdigit()]) == 16
    assert rows(calls.closed_buckets(spark, out).select("bucket", "total_time", "total_requests")) == [
        (US, 500 * US // 4, 500)]


def test_fewer_than_the_cores_stay(spark):
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "3")
    try:
        assert state_tasks(spark) == 3
    finally:
        spark.conf.set(PARTITIONS, before)
