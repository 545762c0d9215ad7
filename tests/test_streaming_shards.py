"""Many keys in one state: few states, time of open operations added up."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import calls
from slowtrace.streaming.run import drain_stateful

US = 1_000_000
BASE = 1_735_689_600 * US
SCHEMA = "tid long, ts long, seq long, kind string, file string"


def at(second, tid, kind, file="f"):
    return (tid, BASE + round(second * US), 0, kind, file)


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, src):
    return read_events_stream(spark, src, SCHEMA).withColumn("event_time", F.timestamp_micros("ts"))


@pytest.mark.parametrize("open_slices", [True, False])
def test_keys_share_states(spark, tmp_path, open_slices):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [e for tid in range(60) for e in (at(0.25, tid, "start"), at(0.75, tid, "end"))] + [at(9, 99, "end")])
    sliced = calls.streaming_slices(stream(spark, src), ["tid"], "start", "end", US, ["file"], "2 seconds", open_slices=open_slices, shards=3)
    seen = []
    write = calls.call_batches(out, ["file"])

    def each(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch.count())

    drain_stateful(sliced, each, ck)
    assert rows(calls.closed_buckets(spark, out).select("total_time", "total_requests")) == [(30 * US, 60)] and sum(seen) == 60
    states = spark.read.format("statestore").option("stateVarName", "closed").load(ck)
    assert 0 < states.count() <= 3


def test_open_time_is_added_up(spark, tmp_path):
    """40 operations that never end, open over 30 buckets: a row per bucket and shard, not per operation."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [at(0.5, tid, "start") for tid in range(40)] + [at(32, 99, "start", "last")])
    told = []
    sliced = calls.streaming_slices(stream(spark, src), ["tid"], "start", "end", US, ["file"], "2 seconds", shards=2)
    write = calls.call_batches(out, ["file"])

    def each(batch, batch_id):
        write(batch, batch_id)
        told.append(batch.count())

    drain_stateful(sliced, each, ck)
    second = ((F.col("bucket") - BASE) / US).cast("int")
    assert rows(calls.closed_buckets(spark, out).select(second, "total_time", "total_requests")) == [
        (0, 20 * US, None), *[(s, 40 * US, None) for s in range(1, 30)]]
    assert sum(told) <= 2 * 30
