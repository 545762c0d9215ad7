"""Bucket sums of many keys: few states, keys told apart as they are."""

import datetime

from pyspark.sql import functions as F

from helpers import rows
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import late
from slowtrace.streaming.run import drain_stateful

US = 1_000_000
BASE = 1_735_689_600 * US
SCHEMA = "sec double, k string, at timestamp, v long"


def test_keys_share_states(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    noon = datetime.datetime(2025, 1, 1, 12)
    keys = [(k, noon + datetime.timedelta(microseconds=i)) for k in ("a", "", None, "null", '{"k":1}') for i in range(4)]
    spark.createDataFrame([(s + 0.5, *k, 1) for k in keys for s in range(5)] + [(30.0, "z", None, 1)], SCHEMA).write.parquet(src)
    stream = read_events_stream(spark, src, SCHEMA).withColumn("ts", F.timestamp_micros((F.lit(BASE) + F.col("sec") * US).cast("bigint")))
    sums = late.sums_and_late_rows(stream, ["k", "at"], {"n": F.lit(1)}, US, "2 seconds", shards=3)
    drain_stateful(sums, late.late_batches(out, ["k", "at"], ["n"]), ck)
    second = ((F.col("bucket") - BASE) / US).cast("int")
    assert rows(late.closed_sums(spark, out).select(second, "k", "at", "n")) == [(s, *k, 1) for k in keys for s in range(5)]
    assert 0 < spark.read.format("statestore").option("stateVarName", "closed").load(ck).count() <= 3
