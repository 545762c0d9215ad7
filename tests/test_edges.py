"""Hand-computed cases for rules that are easy to get wrong."""

import datetime
import ipaddress

import pytest
from pyspark.sql import functions as F

from helpers import rows
from slowtrace.functions import addresses, scalars, timebase
from slowtrace.operators import accounting, intervals as iv, latency, multiplex, relations, series
from slowtrace.operators.correlate import active_series
from slowtrace.operators.discovery import ALWAYS, discover
from slowtrace.operators.ranking import avg_rank, quantile
from slowtrace.operators.shares import device_share, taskstats_view

S = 1_000_000_000


def test_latency_class_bounds_are_inclusive(spark):
    edges = [0, 1000, 1001, 10_000, 10_001, S, S + 1]
    df = spark.createDataFrame([(e,) for e in edges], "ns long")
    assert [r[0] for r in df.select(scalars.log10_bucket(F.col("ns"))).collect()] == [0, 0, 1, 1, 2, 6, 7]


def test_newer_start_replaces_and_unmatched_end_is_ignored(spark):
    log = spark.createDataFrame(
        [("a", "end", 1), ("a", "start", 2), ("a", "start", 5), ("a", "end", 9), ("a", "end", 10), ("b", "start", 3)],
        "k string, kind string, ts long",
    )
    assert rows(iv.pair_events(log, ["k"], "start", "end")) == [("a", 5, 9)]
    assert rows(iv.open_events(log, ["k"], "start", "end")) == [("b", 3)]


def test_slices_add_up_and_touch_the_end(spark):
    df = spark.createDataFrame([(1, S // 2, 3 * S), (2, S, S)], "id int, start long, end long")
    assert rows(iv.split_by_bucket(df, S), "id", "bucket", "slice") == [
        (1, 0, S // 2), (1, S, S), (1, 2 * S, S),
    ]
    touched = iv.split_by_bucket(df, S, touch_end=True)
    assert rows(touched.filter("id = 2"), "bucket", "slice") == [(S, 0)]
    assert rows(touched.filter("id = 1 and slice = 0"), "bucket") == [(3 * S,)]


def test_an_empty_interval_covers_no_bucket(spark):
    df = spark.createDataFrame([(1, S, S), (2, S + 5, S + 5), (3, S + 5, S + 6)], "id int, start long, end long")
    assert rows(iv.split_by_bucket(df, S), "id", "slice") == [(3, 1)]
    assert rows(iv.split_by_bucket(df, S, touch_end=True).filter("slice = 0"), "id", "bucket") == [(1, S), (2, S)]


def test_end_on_a_boundary_counts_in_the_bucket_it_starts(spark):
    calls = spark.createDataFrame([(1, S // 2, 2 * S)], "tid int, start long, end long")
    got = accounting.call_stats(calls, ["tid"], S).select("bucket", "total_time", "total_requests", "hist7")
    assert rows(got) == [(0, S // 2, None, None), (2 * S, 0, 1, 1), (S, S, None, None)]


def test_block_io_is_not_sliced(spark):
    done = spark.createDataFrame([(1, S // 2, 2 * S + 5, 8)], "tid int, start long, end long, size long")
    got = accounting.io_stats(done, ["tid"], S).select("bucket", "total_time", "sector_cnt", "total_requests")
    assert rows(got) == [(2 * S, 2 * S + 5 - S // 2, 8, 1)]


def test_an_end_before_its_start_fails_and_can_be_set_aside(spark):
    calls = spark.createDataFrame([(1, 5, 9), (2, 9, 5), (3, 4, None)], "tid int, start long, end long")
    wrong = iv.inverted_intervals(calls)
    assert rows(wrong, "tid") == [(2,)]
    for refused in (
        accounting.call_stats(calls, ["tid"], 10), iv.split_by_bucket(calls, 10), iv.active_at_ticks(calls, 10),
    ):
        with pytest.raises(Exception, match="ends before it starts: 9 > 5"):
            refused.collect()
    kept = accounting.call_stats(iv.without_inverted(calls), ["tid"], 10)
    assert rows(kept, "tid", "total_time", "total_requests") == [(1, 4, 1)]


def test_open_call_is_accounted_to_the_horizon_without_a_count(spark):
    calls = spark.createDataFrame([(1, S // 2, None)], "tid int, start long, end long")
    got = accounting.call_stats(calls, ["tid"], S, horizon=2 * S).select("bucket", "total_time", "total_requests")
    assert rows(got) == [(0, S // 2, None), (S, S, None)]


def test_merge_adds_all_staged_slices_and_inserts_without_counts(spark):
    target = spark.createDataFrame([(1, "a", 10, 2, 1)], "bucket int, k string, total_time long, total_requests long, hist0 long")
    staging = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (2, "a", 3)], "bucket int, k string, additional_time long")
    got = accounting.merge_pending(target, staging, ["bucket", "k"])
    assert rows(got) == [(1, "a", 22, 2, 1), (2, "a", 3, None, None)]
    assert rows(accounting.new_keys(staging, target, ["bucket", "k"])) == [(2, "a", 3)]


def test_pending_slices_plus_completion_equal_the_call(spark):
    calls = spark.createDataFrame([(1, 300, 2450), (1, 10, 20), (1, 1900, 2000)], "tid int, start long, end long")
    staged = accounting.pending_slices(calls, 1000, "start", "end", ["tid"])
    assert rows(staged) == [(0, 1, 700), (1000, 1, 100), (1000, 1, 1000)]


def _snaps(spark, data):
    names = "sec int, tid long, run_time_total long, rq_time_total long, uninterruptible_total long, blkio_time_total long"
    base = spark.createDataFrame(data, names)
    stamp = F.timestamp_add("SECOND", F.col("sec"), F.lit(datetime.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    return base.withColumns({"ts": stamp, "pid": F.lit(1).cast("bigint"), "comm": F.lit("c")})


def test_shares_first_snapshot_dropped_and_reused_thread_has_no_share(spark):
    view = taskstats_view(_snaps(spark, [
        (0, 1, 0, 0, 0, 0), (2, 1, S, S // 2, S // 4, S // 4), (3, 1, 5, 0, 0, 0), (3, 1, 5, 0, 0, 0),
    ]))
    got = rows(view, "time_diff", "run_share", "rq_share", "uninterruptible_share", "blkio_share", "interruptible_share")
    assert (2 * S, 0.5, 0.25, 0.125, 0.125, 0.125) in got
    assert (S, None, None, None, None, None) in got
    assert (0, None, None, None, None, 0.0) in got
    assert len(got) == 3


def test_shares_may_exceed_the_interval_but_rest_is_not_negative(spark):
    view = taskstats_view(_snaps(spark, [(0, 1, 0, 0, 0, 0), (1, 1, 2 * S, 0, 0, 0)]))
    assert rows(view, "run_share", "interruptible_share") == [(2.0, 0.0)]


def test_calendar_end_is_open_with_an_interval_and_closed_without(spark):
    points = spark.createDataFrame([("a", 10, 1.0), ("a", 13, 2.0), ("b", 12, 5.0)], "series_id string, epoch_s long, value double")
    assert rows(series.densify(points).filter("series_id = 'b'"), "epoch_s") == [(10,), (11,), (12,), (13,)]
    wide = series.densify(points, interval=(9, 15)).filter("series_id = 'b'")
    assert rows(wide, "epoch_s") == [(10,), (11,), (12,), (13,), (14,), (9,)]
    inside = series.densify(points, interval=(11, 12)).filter("series_id = 'a'")
    assert rows(inside, "epoch_s") == [(10,), (11,), (12,), (13,)]


def test_throughput_counts_both_borders(spark):
    log = spark.createDataFrame([(0, 10), (0, 20), (0, 20), (0, 25), (0, 30)], "start long, end long")
    assert rows(latency.throughput(log, 10)) == [(1, 3), (2, 4)]
    assert rows(latency.throughput(log, 10, half_open=True)) == [(1, 1), (2, 3)]


def test_ticks_start_at_the_first_start(spark):
    log = spark.createDataFrame([(3, 8, 5), (14, 30, 16)], "start long, end long, duration long")
    # tick 13: the first request ended at 8 and 8 > 13 - 10; tick 23 sees only the second
    assert rows(iv.active_at_ticks(log, 10), "tick", "duration") == [(13, 5), (23, 16), (3, 5)]


def test_hdr_quantile_and_empty_tick(spark):
    log = spark.createDataFrame([(0, 5, 1000), (40, 45, 7)], "start long, end long, duration long")
    got = latency.response_percentiles_hdr(log, 0.95, 10)
    assert rows(got) == [(0, 1003), (1, 1003), (2, 0), (3, 0), (4, 7)]


def test_hdr_slots(spark):
    df = spark.createDataFrame([(0,), (1,), (255,), (256,), (257,), (511,), (512,), (60_000_000,)], "v long")
    got = [r[0] for r in df.select(latency.hdr_value(F.col("v"))).collect()]
    assert got == [0, 1, 255, 257, 257, 511, 515, 60030975]


def test_equal_requests_count_once_each(spark):
    log = spark.createDataFrame([(0, 1, 4), (0, 1, 4), (0, 1, 10)], "start long, end long, duration long")
    got = latency.response_percentiles(log, 0.5, 1, slo=3.0)
    assert ("0", 4.0, 1.0) in [(str(a), b, c) for a, b, c in rows(got)]


def test_no_value_is_no_violation(spark):
    log = spark.createDataFrame([(0, 1, 9), (30, 31, 9)], "start long, end long, duration long")
    got = {r.epoch_s: (r.percentile_value, r.slo_violation) for r in latency.response_percentiles(log, 0.9, 5, slo=1).collect()}
    assert got[10] == (None, 0.0) and got[0] == (9.0, 1.0)


def test_ipv6_text_is_canonical(spark):
    texts = [
        "::", "::1", "1::", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "2001:0:0:1::1", "1:0:0:2:0:0:3:4", "fe80::1:0:0:0",
        "::ffff:10.1.2.3", "0:1:0:1:0:1:0:1", "1:2:3:4:5:6:7:8", "::ffff:0:0:1",
    ]
    data = [(ipaddress.IPv6Address(t).packed.hex(), str(ipaddress.IPv6Address(t))) for t in texts]
    df = spark.createDataFrame(data, "h string, want string").withColumn("g", addresses.ipv6_groups(F.col("h"))).withColumn("got", addresses.ipv6_compressed("g"))
    for row in df.collect():
        want = row.want
        if ipaddress.IPv6Address(want).ipv4_mapped:
            want = f"::ffff:{ipaddress.IPv6Address(want).ipv4_mapped}"
        assert row.got == want


def test_futex_op(spark):
    df = spark.createDataFrame([(0,), (128,), (9 | 128 | 256,), (1,), (10 | 256,), (5,), (129,)], "op int")
    assert [r[0] for r in df.select(scalars.normalize_futex_op(F.col("op"))).collect()] == [0, 0, 0, 1, 1, None, 1]


def test_device_number(spark):
    df = spark.createDataFrame([(264241153,)], "d long")
    assert df.select(scalars.device_label(F.col("d"))).first()[0] == "252:1"


def test_saturation_turns_on_at_ninety_percent(spark):
    row = spark.range(1).select(scalars.saturation(F.lit(0.9)), scalars.saturation(F.lit(1.0)), scalars.saturation(F.lit(0.5))).first()
    assert row[0] == pytest.approx(0.5) and row[1] > 0.99 and row[2] < 1e-10


def test_seconds_keep_the_phase_of_the_offset(spark):
    df = spark.createDataFrame([(5 * S + 1,), (5 * S + 999_999_999,)], "b long")
    got = {r[0] for r in df.select(timebase.boot_second_to_epoch(F.col("b"), 9_116_000)).collect()}
    assert got == {5 * S + 9_116_000}


def test_epoch_us_does_not_depend_on_the_session_time_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 12:00:00.000001' AS ts")
    want = 1719835200000001
    assert df.select(timebase.epoch_us(F.col("ts"))).first()[0] == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(timebase.epoch_us(F.col("ts"))).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_wake_is_zero_and_only_shared_locks_count(spark):
    waits = spark.createDataFrame([(1, "x", 1, 0.5), (1, "x", 2, 0.25), (1, "y", 1, 9.0)], "tid long, resource string, epoch_s long, value double")
    wakes = spark.createDataFrame([(2, "x", 1, 4.0), (2, "x", 3, 1.0), (2, "z", 1, 7.0)], "tid long, resource string, epoch_s long, value double")
    assert rows(relations.wait_wake_product(waits, wakes, 1, 2)) == [(1, 2.0), (2, 0.0), (3, 0.0)]


def test_wide_device_numbers_are_not_mixed(spark):
    pairs = [(0, 0), (252, 1), (4095, 2**20 - 1), (299, 2**20), (7, 1_200_000), (4096, 5), (2**32 - 1, 2**32 - 1), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("d", scalars.encode_device(F.col("a"), F.col("b")))
    assert rows(df.filter("d IS NOT NULL").select(scalars.device_major(F.col("d")), scalars.device_minor(F.col("d")))) == pairs[:-1]
    # numbers of the kernel stay as they are
    assert rows(df.filter("a < 4096 AND b < 1048576 AND d <> a * 1048576 + b")) == []
    with pytest.raises(Exception, match="no device number: 1:-1"):
        spark.sql("SELECT 1L a, -1L b").select(scalars.encode_device(F.col("a"), F.col("b"))).collect()


def test_device_without_load_has_share_zero(spark):
    df = spark.createDataFrame([(1, 8, 1, 1, 0), (1, 9, 1, 1, 3), (1, 9, 1, 2, 1)], "epoch_s long, device long, pid long, tid long, sector_cnt long")
    assert rows(device_share(df), "device", "tid", "share") == [(8, 1, 0.0), (9, 1, 0.75), (9, 2, 0.25)]


def _mux(spark, data):
    schema = "kind string, ts long, seq long, poll_id long, pid long, tid long, fs_magic int, device_id int, inode_id long"
    return spark.createDataFrame([(k, t, i, p, 1, tid, 0, 0, f) for i, (k, t, p, tid, f) in enumerate(data)], schema)


def test_epoll_session_lasts_from_first_waiter_to_last(spark):
    log = _mux(spark, [
        ("epoll_insert", 100, 7, None, 5), ("epoll_start", 200, 7, 1, None), ("epoll_start", 300, 7, 2, None),
        ("epoll_end", 400, 7, 1, None), ("epoll_insert", 500, 7, None, 6), ("epoll_end", 1200, 7, 2, None),
    ])
    got = multiplex.muxio_file_wait(log, bucket=1000, horizon=2000, cell_width=250)
    assert rows(got, "bucket", "inode_id", "total_time", "count") == [(0, 5, 800, 0), (0, 6, 500, 0), (1000, 5, 200, 1), (1000, 6, 200, 1)]
    threads = multiplex.muxio_wait(log, bucket=1000, horizon=2000, cell_width=250)
    assert rows(threads, "bucket", "tid", "total_time", "total_requests") == [(0, 1, 200, 1), (0, 2, 700, 0), (1000, 2, 200, 1)]


def test_file_removed_while_idle_stays_registered_unless_asked(spark):
    log = _mux(spark, [
        ("epoll_insert", 0, 7, None, 5), ("epoll_remove", 10, 7, None, 5), ("epoll_start", 20, 7, 1, None), ("epoll_end", 50, 7, 1, None),
    ])
    kept = multiplex.muxio_file_wait(log, 1000, 1000, 250)
    assert rows(kept, "inode_id", "total_time", "count") == [(5, 30, 1)]
    assert multiplex.muxio_file_wait(log, 1000, 1000, 250, idle_removals=True).count() == 0


def test_removal_in_a_session_counts_at_the_removal(spark):
    log = _mux(spark, [
        ("epoll_start", 0, 7, 1, None), ("epoll_insert", 100, 7, None, 5), ("epoll_remove", 250, 7, None, 5),
        ("epoll_insert", 300, 7, None, 5), ("epoll_end", 700, 7, 1, None),
    ])
    assert rows(multiplex.muxio_file_wait(log, 1000, 1000, 250), "total_time", "count") == [(550, 2)]


def test_poll_files_are_waited_for_until_the_call_ends(spark):
    log = _mux(spark, [
        ("poll_start", 100, None, 1, None), ("poll_register", 110, None, 1, 5), ("poll_register", 130, None, 1, 6),
        ("poll_end", 400, None, 1, None), ("poll_end", 500, None, 1, None), ("poll_register", 550, None, 1, 5),
        ("poll_start", 600, None, 1, None), ("poll_end", 1100, None, 1, None),
    ])
    got = multiplex.muxio_file_wait(log, 1000, 2000, 250)
    assert rows(got, "bucket", "inode_id", "total_time", "count") == [(0, 5, 690, 1), (0, 6, 270, 1), (1000, 5, 100, 1)]
    packed = (1 << 32) + 1
    assert {r.poll_id for r in got.collect()} == {packed}


def test_discovery_follows_time(spark):
    acc = spark.createDataFrame(
        [(1, "p", 10), (2, "p", 5), (2, "p", 20), (3, "q", 15), (2, "q", 25), (3, "q", 30), (4, "r", 40), (5, "p", 10)],
        "pid long, resource string, ts long",
    )
    seeds = spark.createDataFrame([(1,)], "pid long")
    tracked, registered = discover(acc, seeds)
    assert rows(tracked, "pid", "discovered_at", "via", "hop") == [(1, ALWAYS, None, 0), (2, 20, "p", 1), (3, 30, "q", 2)]
    assert rows(registered) == [("p", 10), ("q", 25)]
    one_hop, _ = discover(acc, seeds, max_hops=1)
    assert rows(one_hop, "pid") == [(1,), (2,)]


def test_discovery_takes_the_earlier_of_two_ways(spark):
    acc = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 100), (1, "b", 2), (3, "b", 3), (3, "c", 4), (2, "c", 5), (2, "d", 6), (4, "d", 7)],
        "pid long, resource string, ts long",
    )
    tracked, _ = discover(acc, spark.createDataFrame([(1,)], "pid long"))
    assert {r.pid: r.discovered_at for r in tracked.collect()} == {1: ALWAYS, 2: 5, 3: 3, 4: 7}


def test_discovery_crosses_socket_peers(spark):
    acc = spark.createDataFrame([(1, "s1", 10), (2, "s2", 5), (2, "s2", 12)], "pid long, resource string, ts long")
    peers = spark.createDataFrame([("s2", "s1")], "a string, b string")
    tracked, registered = discover(acc, spark.createDataFrame([(1,)], "pid long"), peers)
    assert {r.pid: r.discovered_at for r in tracked.collect()} == {1: ALWAYS, 2: 12}
    assert rows(registered) == [("s1", 10), ("s2", 10)]


def test_null_keys_are_groups_like_any_other(spark):
    log = spark.createDataFrame([(None, "start", 5), (None, "end", 25), (1, "start", 6), (1, "end", 30)], "k int, kind string, ts long")
    for width in (None, 10):
        pairs = iv.pair_events(log, ["k"], "start", "end", cell_width=width).collect()
        assert {(r["k"], r["start"], r["end"]) for r in pairs} == {(None, 5, 25), (1, 6, 30)}
    samples = spark.createDataFrame([(1, None, 1, 1, 30), (1, None, 1, 2, 10), (1, 7, 1, 1, 5)],
                                    "epoch_s long, device int, pid int, tid int, sector_cnt long")
    assert {(r["device"], r["tid"], r["share"]) for r in device_share(samples).collect()} == {(None, 1, 0.75), (None, 2, 0.25), (7, 1, 1.0)}
    points = spark.createDataFrame([(None, float(v)) for v in (1, 2, 9)] + [("a", 4.0)], "s string, value double")
    assert {(r["s"], r["quantile"]) for r in quantile(points, ["s"], "value", 0.5).collect()} == {(None, 2.0), ("a", 4.0)}
    assert active_series(points, "max", 5.0, ["s"]).count() == 3
    ranked = avg_rank(points, ["s"], "value").collect()
    assert {(r["s"], r["value"], r["rank"]) for r in ranked} == {(None, 1.0, 1.0), (None, 2.0, 2.0), (None, 9.0, 3.0), ("a", 4.0, 1.0)}
    assert accounting.new_keys(points.select("s").distinct(), points.where("s IS NULL"), ["s"]).collect()[0]["s"] == "a"
