"""Operations paired in a stream: disorder over restarts, open time, replaced starts, odd events."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from slowtrace.operators import accounting, intervals
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import calls
from slowtrace.streaming.run import drain_stateful

US = 1_000_000
BASE = 1_735_689_600 * US
SCHEMA = "tid long, ts long, seq long, kind string, file string, size long"


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def slices(spark, src, **options):
    stream = read_events_stream(spark, src, SCHEMA).withColumn("event_time", F.timestamp_micros("ts"))
    return calls.streaming_slices(stream, ["tid"], "start", "end", US, ["file", "size"], "2 seconds", **options)


def at(second, tid, kind, file="f", size=1, seq=0):
    return (tid, BASE + round(second * US), seq, kind, file, size)


def shown(df):
    return rows(df.select(((F.col("bucket") - BASE) / US).cast("int"), "file", "total_time", "total_requests"))


def test_open_time_comes_second_by_second(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def run():
        drain_stateful(slices(spark, src), calls.call_batches(out, ["file"]), ck)
        return shown(calls.closed_buckets(spark, out))

    # watermark 4.0: seconds 0 to 3 are closed, thread 1 is open since 0.5, and its end has not arrived
    put(spark, src, [at(0.5, 1, "start", "a"), at(1.25, 2, "start", "b"), at(1.5, 2, "end"), at(6.0, 3, "start", "c")])
    assert run() == [(0, "a", 500_000, None), (1, "a", US, None), (2, "a", US, None), (3, "a", US, None), (1, "b", 250_000, 1)]
    # the end lies in second 5; nothing that was told changes
    put(spark, src, [at(5.75, 1, "end"), at(9.0, 3, "end")])
    got = run()
    assert (4, "a", US, None) in got and (5, "a", 750_000, 1) in got and (6, "c", US, None) in got
    assert sum(r[2] for r in got if r[1] == "a") == 5_250_000 and (9, "c", 0, 1) not in got
    put(spark, src, [at(20.0, 9, "end")])
    assert (9, "c", 0, 1) in run()


def test_odd_events(spark, tmp_path):
    """An end without a start, two ends, a start that replaces one, equal times, a NULL payload, a NULL kind."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [
        at(0.1, 1, "end"), at(0.2, 1, "start", "old"), at(0.4, 1, "start", "new"), at(0.6, 1, "end"), at(0.9, 1, "end"),
        at(1.5, 2, "start", "x", seq=2), at(1.5, 2, "end", seq=3), at(1.5, 2, "end", seq=1), at(2.5, 3, "start", None, None),
        at(2.75, 3, "end", None, None), at(2.8, None, "start", "null"), at(2.9, None, "end"), at(2.0, 4, None), at(30.0, 5, "end"),
    ])
    drain_stateful(slices(spark, src), calls.call_batches(out, ["file"]), ck)
    assert shown(calls.closed_buckets(spark, out)) == [
        (0, "new", 200_000, 1), (1, "x", 0, 1), (2, None, 250_000, 1), (2, "null", 100_000, 1)]


@pytest.mark.parametrize("open_slices", [True, False])
def test_equals_batch_over_random_logs(spark, tmp_path, open_slices):
    rng = random.Random(11)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    log = []
    for tid in range(12):
        second = rng.random()
        while second < 30:
            log.append(at(second, tid, "start", rng.choice("ab"), rng.randrange(9), len(log)))
            second += rng.choice([0.01, 0.5, 1, 4]) * rng.random()
            log.append(at(second, tid, "end", None, None, len(log)))
            second += rng.random()
    arrival = sorted(log, key=lambda e: e[1] + rng.randrange(US))
    for part in range(4):
        put(spark, src, arrival[part * len(arrival) // 4:(part + 1) * len(arrival) // 4])
        write = calls.call_batches(out, ["file"]) if open_slices else calls.io_batches(out, ["file"], "size")
        drain_stateful(slices(spark, src, open_slices=open_slices), write, ck)
    paired = intervals.pair_events(spark.createDataFrame(log, SCHEMA), ["tid"], "start", "end", order=["ts", "seq"],
                                   payload=["file", "size"], cell_width=None)
    closed = (max(e[1] for e in log) - 2 * US) // US * US
    want = accounting.call_stats(paired, ["file"], US) if open_slices else accounting.io_stats(paired, ["file"], US)
    got = calls.closed_buckets(spark, out)
    names = sorted(got.columns)
    assert rows(got.select(*names)) == rows(want.filter(F.col("bucket") < closed).select(*names)) and got.count() > 40


def test_batch_again_counts_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [at(0.5, 1, "start"), at(0.75, 1, "end"), at(9.0, 1, "start")])
    write = calls.call_batches(out, ["file"])

    def twice(df, batch_id):
        write(df, batch_id)
        write(df, batch_id)

    drain_stateful(slices(spark, src), twice, ck)
    assert shown(calls.closed_buckets(spark, out)) == [(0, "f", 250_000, 1)]


def test_quitting_ends_uncounted(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [at(0.5, 1, "start", "a"), at(2.25, 1, "quit"), at(2.5, 1, "end"), at(1.0, 2, "quit"), at(1.5, 2, "start", "b"),
                     at(1.75, 2, "end"), at(30.0, 3, "start")])
    drain_stateful(slices(spark, src, quit_kind="quit"), calls.wait_batches(out, ["file"]), ck)
    assert shown(calls.closed_buckets(spark, out).filter("file <> 'f'")) == [
        (0, "a", 500_000, 0), (1, "a", US, 0), (2, "a", 250_000, 0), (1, "b", 250_000, 1)]


def test_nothing_written_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        calls.closed_buckets(spark, str(tmp_path / "none"))
