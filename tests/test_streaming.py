"""Streams: late data, closed buckets, replays, and agreement with the batch operators."""

import datetime

from pyspark.sql import functions as F

from helpers import rows
from slowtrace.operators import accounting, multiplex
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import discovery, merge, replay, stats, waits
from slowtrace.streaming.run import drain_batches, drain_to_parquet

T0 = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)
US = 1_000_000
BASE = int(T0.timestamp()) * US


def put(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_open_buckets_wait(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "sec double, k string, latency_ns long"

    def run():
        stream = read_events_stream(spark, src, schema).withColumn(
            "ts", F.timestamp_micros((F.lit(BASE) + F.col("sec") * US).cast("bigint"))
        )
        drain_to_parquet(stats.streaming_io_stats(stream, ["k"], "1 second", "2 seconds"), out, ck)
        return rows(spark.read.parquet(out).select(
            ((F.col("bucket") - BASE) / US).cast("int"), "k", "total_time", "total_requests", "hist0", "hist7"
        ))

    put(spark, src, [(0.1, "a", 500), (0.9, "a", 2_000_000_000), (1.5, "a", 10), (5.0, "b", 1)], schema)
    assert run() == [(0, "a", 2_000_000_500, 2, 1, 1), (1, "a", 10, 1, 1, 0)]
    # 0.5 and 2.5 s are behind the watermark of 3 s by now; 4 s is not
    put(spark, src, [(0.5, "a", 99), (4.2, "a", 7), (20.0, "a", 1)], schema)
    got = run()
    assert (4, "a", 7, 1, 1, 0) in got and (5, "b", 1, 1, 1, 0) in got and len(got) == 4


def test_wait_machine_equals_batch_over_several_micro_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    log = [  # seconds, kind, thread, file
        (0.2, "epoll_insert", None, "f1"), (0.5, "epoll_start", "t1", None), (0.7, "epoll_start", "t2", None),
        (1.4, "epoll_end", "t1", None), (1.6, "epoll_insert", None, "f2"), (3.3, "epoll_end", "t2", None),
        (3.5, "epoll_remove", None, "f1"), (4.0, "epoll_start", "t1", None), (4.4, "epoll_remove", None, "f2"),
        (9.1, "epoll_end", "t1", None), (30.0, "epoll_start", "t9", None),
    ]
    schema = "poll_id string, ts long, seq long, kind string, thread string, file string"
    data = [("7", BASE + int(s * US), i, k, t, f) for i, (s, k, t, f) in enumerate(log)]

    def run():
        stream = read_events_stream(spark, src, schema).withColumn("event_time", F.timestamp_micros("ts"))
        drain_to_parquet(waits.streaming_waits(stream, US, "2 seconds"), out, ck)

    # rows within the delay may come out of order and in different batches
    put(spark, src, [data[i] for i in (1, 0, 3, 2)], schema)
    run()
    put(spark, src, [data[i] for i in (5, 4, 6)], schema)
    run()
    put(spark, src, data[7:], schema)
    run()
    got = spark.read.parquet(out)

    names = {f"t{i}": i for i in range(10)} | {f"f{i}": i for i in range(10)}
    events = spark.createDataFrame(
        [(k, ts, seq, 7, 1, names.get(t), 0, 0, names.get(f)) for (_, ts, seq, k, t, f) in data[:-1]],
        "kind string, ts long, seq long, poll_id long, pid long, tid long, fs_magic int, device_id int, inode_id long",
    )
    threads = multiplex.muxio_wait(events, US, horizon=BASE + 28 * US, cell_width=US)
    assert rows(waits.thread_waits(got), "bucket", F.substring("name", 2, 3).cast("int"), "total_time", "total_requests") == list(
        rows(threads, "bucket", "tid", "total_time", "total_requests")
    )
    files = multiplex.muxio_file_wait(events, US, horizon=BASE + 28 * US, cell_width=US)
    nonzero = waits.file_waits(got).filter("total_time > 0 or total_requests > 0")
    assert rows(nonzero, "bucket", F.substring("name", 2, 3).cast("int"), "total_time", "total_requests") == list(
        rows(files, "bucket", "inode_id", "total_time", "count")
    )


def test_exits_and_closed_sets_end_waits_uncounted(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    log = [
        (0.1, "epoll_insert", None, "f"), (0.2, "epoll_start", "t1", None), (1.5, "thread_exit", "t1", None),
        (4.0, "epoll_start", "t2", None), (5.25, "set_closed", None, None), (5.5, "epoll_start", "t3", None),
        (5.75, "epoll_end", "t3", None), (60.0, "thread_exit", "t9", None),
    ]
    data = [("7", BASE + int(s * US), i, k, t, f) for i, (s, k, t, f) in enumerate(log)]
    schema = "poll_id string, ts long, seq long, kind string, thread string, file string"
    for part in (data[:2], data[2:]):
        put(spark, src, part, schema)
        stream = read_events_stream(spark, src, schema).withColumn("event_time", F.timestamp_micros("ts"))
        drain_to_parquet(waits.streaming_waits(stream, US, "2 seconds"), out, ck)
    got = spark.read.parquet(out)
    second = ((F.col("bucket") - BASE) / US).cast("int").alias("second")
    assert rows(waits.thread_waits(got), second, "name", "total_time", "total_requests") == [
        (0, "t1", 800_000, 0), (1, "t1", 500_000, 0), (4, "t2", 1_000_000, 0), (5, "t2", 250_000, 0), (5, "t3", 250_000, 1),
    ]
    assert rows(waits.file_waits(got), second, "total_time", "total_requests") == [
        (0, 800_000, 0), (1, 500_000, 0), (4, 1_000_000, 0), (5, 250_000, 0),
    ]


def test_staged_batch_run_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "staged")
    write = merge.stage_batches(path)
    batch = spark.createDataFrame([(1, "a", 5)], "bucket int, k string, additional_time long")
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    target = spark.createDataFrame([(1, "a", 1, 1)], "bucket int, k string, total_time long, total_requests long")
    assert rows(merge.merged(spark, target, f"{path}-none", ["bucket", "k"])) == [(1, "a", 1, 1)]
    assert rows(merge.merged(spark, target, path, ["bucket", "k"])) == [(1, "a", 11, 1)]
    assert rows(accounting.new_keys(batch, target, ["bucket", "k"])) == []


def test_discovery_grows_over_batches_and_exits_leave(spark, tmp_path):
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    schema = "pid long, resource string, ts long"
    discovery.start_state(spark, state, spark.createDataFrame([(1,)], "pid long"))
    exits = spark.createDataFrame([(2, 50)], "pid long, exited_at long")

    def run():
        return drain_batches(read_events_stream(spark, src, schema), discovery.discover_batches(state, exits=exits), ck)

    put(spark, src, [(1, "p", 10), (2, "p", 20), (3, "q", 21)], schema)
    last = run()
    assert rows(discovery.tracked_at(spark, state, last), "pid") == [(1,), (2,)]
    put(spark, src, [(2, "q", 30), (3, "q", 31)], schema)
    last = run()
    assert rows(discovery.tracked_at(spark, state, last), "pid", "via") == [(1, None), (2, "p"), (3, "q")]
    put(spark, src, [(1, "r", 60)], schema)
    last = run()
    assert rows(discovery.tracked_at(spark, state, last), "pid", "via") == [(1, None), (3, "q")]


def test_replay_in_batches_equals_one_batch(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    schema = "kind string, ts long, seq long, poll_id long, pid long, tid long, fs_magic int, device_id int, inode_id long"
    log = [
        (0.2, "epoll_insert", 7, None, 5), (0.5, "epoll_start", 7, 1, None), (0.7, "epoll_start", 7, 2, None),
        (1.4, "epoll_end", 7, 1, None), (2.0, "poll_start", None, 3, None), (2.1, "poll_register", None, 3, 8),
        (3.3, "epoll_end", 7, 2, None), (4.0, "epoll_start", 7, 1, None), (6.4, "poll_end", None, 3, None),
        (7.4, "epoll_remove", 7, None, 5), (9.1, "epoll_end", 7, 1, None), (12.0, "epoll_start", 7, 9, None),
        (20.5, "epoll_insert", 7, None, 6), (30.0, "epoll_start", 7, 4, None),
    ]
    data = [(k, int(s * US), i, p, 1, tid, 0, 0, f) for i, (s, k, p, tid, f) in enumerate(log)]
    each = replay.replay_batches(path, US, 2 * US, US)
    for part in (data[:3], data[3:6], data[6:8], data[8:]):
        put(spark, src, part, schema)
        drain_batches(read_events_stream(spark, src, schema), each, ck)
    events = spark.createDataFrame(data[:-1], schema)
    want = multiplex.muxio_wait(events, US, 28 * US, US)
    assert rows(replay.replayed_waits(spark, path, "thread_waits"), *want.columns) == list(rows(want))
    want = multiplex.muxio_file_wait(events, US, 28 * US, US)
    assert rows(replay.replayed_waits(spark, path, "file_waits"), *want.columns) == list(rows(want))
