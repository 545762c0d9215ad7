"""The three ways in, end to end on small inputs."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from helpers import rows
from slowtrace.plans.jobs import RawLogs, request_report, store_run, suspects, tree_rates
from slowtrace.session import settle, settled_tables
from slowtrace.sources.store import register_views
from test_sources import put

S = 1_000_000_000


def test_raw_logs_to_views(spark, tmp_path):
    calls = spark.createDataFrame(
        [("start", S // 2, 0, 1, 11, 3, 0, 700, 0), ("end", S + 5, 1, 1, 11, None, None, None, None)],
        "kind string, ts long, seq long, pid long, tid long, fs_magic long, device_id long, inode_id long, op int",
    )
    futex = spark.createDataFrame(
        [("start", 10, 0, 1, 11, 9, 128, 0), ("end", 2010, 1, 1, 11, 9, 128, 0), ("end", 5000, 2, 1, 12, 9, 1, 3), ("end", 6000, 3, 1, 12, 9, 1, 0),
         ("start", 7000, 4, 1, 12, 9, 5, 0)],
        "kind string, ts long, seq long, pid long, tid long, futex_key_addr long, op int, ret int",
    ).withColumns({"futex_key_word": F.lit(0), "futex_key_offset": F.lit(4)})
    block = spark.createDataFrame(
        [("start", 100, 0, 8, 5, 1, 1, 11, 8, 16), ("end", 5100, 1, 8, 5, 1, None, None, None, None)],
        "kind string, ts long, seq long, part0 long, sector long, op int, pid long, tid long, bdev long, size long",
    )
    muxio = spark.createDataFrame(
        [("epoll_insert", 0, 0, 77, None, None, 3, 0, 700), ("epoll_start", 100, 1, 77, 1, 11, None, None, None), ("epoll_end", 400, 2, 77, 1, 11, None, None, None)],
        "kind string, ts long, seq long, poll_id long, pid long, tid long, fs_magic long, device_id long, inode_id long",
    )
    sockets = spark.createDataFrame(
        [(700, 1, 2, 1, 6, 16777343, 16777343, None, None, 8080, 20480)],
        "inode_id long, netns_cookie long, family int, type int, protocol int, src_addr4 long, dst_addr4 long, src_addr6 string, dst_addr6 string, src_port int, dst_port int",
    )
    peers = spark.createDataFrame([(700, 701)], "sock1_inode_id long, sock2_inode_id long")
    names = spark.createDataFrame([("AF_INET", 2)], "identifier string, value long")
    logs = RawLogs(calls=calls, futex=futex, block_io=block, muxio=muxio, sockets=sockets, peers=peers, identifiers=names)
    views = store_run(spark, logs, str(tmp_path / "store"), "r1", boot_offset_ns=9_116_000)
    assert set(views) == {"vfs", "futex_wait", "futex_wake", "iowait", "muxio_wait", "muxio_file_wait", "socket_context",
                          "socket_inet", "socket_map", "linux_consts"}
    ask = lambda sql: rows(spark.sql(sql))
    assert ask("SELECT CAST(ts_s AS STRING), total_time, total_requests, hist6 FROM vfs") == [
        ("1970-01-01 00:00:00.009116", S // 2, None, None), ("1970-01-01 00:00:01.009116", 5, 1, 1),
    ]
    assert ask("SELECT tid, total_time, total_requests, hist1 FROM futex_wait") == [(11, 2000, 1, 1)]
    assert ask("SELECT tid, total_requests, successful_count FROM futex_wake") == [(12, 2, 1)]
    assert ask("SELECT total_time, sector_cnt, total_requests FROM iowait") == [(5000, 16, 1)]
    assert ask("SELECT tid, poll_id, total_time, total_requests FROM muxio_wait") == [(11, 77, 300, 1)]
    assert ask("""SELECT m.total_time, i.src_address, i.src_port, i.dst_port, c.const_name, p.sock2_inode_id
        FROM muxio_file_wait m JOIN socket_inet i USING (inode_id) JOIN socket_context s USING (inode_id)
        JOIN linux_consts c ON c.const_type = 'socket_family' AND c.value = s.family
        JOIN socket_map p ON p.sock1_inode_id = m.inode_id""") == [(300, "127.0.0.1", 8080, 80, "AF_INET", 701)]



def test_open_calls_boot_time_snapshots_and_missing_tables(spark, tmp_path):
    calls = spark.createDataFrame(
        [("start", 100, 0, 1, 11, 3, 0, 700, 0), ("end", 300, 1, 1, 11, None, None, None, None),
         ("start", S - 50, 2, 1, 11, 3, 0, 701, 0)],
        "kind string, ts long, seq long, pid long, tid long, fs_magic long, device_id long, inode_id long, op int",
    )
    snapshots = spark.createDataFrame([(2 * S, 1, 11)], "ts long, pid long, tid long")
    path = str(tmp_path / "store")
    store_run(spark, RawLogs(calls=calls, taskstats=snapshots), path, "r1", boot_offset_ns=S, horizon=S + 70)
    got = rows(spark.sql("SELECT CAST(ts_s AS STRING), inode_id, total_time, total_requests FROM vfs"))
    assert set(got) == {("1970-01-01 00:00:01", 700, 200, 1), ("1970-01-01 00:00:01", 701, 50, None),
                        ("1970-01-01 00:00:02", 701, 70, None)}
    assert rows(spark.sql("SELECT CAST(ts AS STRING) FROM taskstats")) == [("1970-01-01 00:00:03",)]
    assert "futex_wait" in register_views(spark, path) and spark.table("futex_wait").isEmpty()


def test_metric_tree_to_suspects(spark, tmp_path):
    root = str(tmp_path)
    busy = [0, 100, 150, 450, 1250]
    put(root, "system-metrics/thread/5/51/sched/1.csv", "epoch_ms,runtime\n" + "".join(f"{1000 * (i + 1)},{v}\n" for i, v in enumerate(busy)))
    put(root, "system-metrics/thread/5/51/sched/2.csv", "epoch_ms,runtime\n5000,9999\n6000,1350\n")
    put(root, "system-metrics/thread/5/52/futex/wait/1/5-0xab.csv", "epoch_ms,futex_wait_ns\n2000,500000000\n4000,500000000\n")
    put(root, "system-metrics/thread/5/52/futex/wake/1/5-0xab.csv", "epoch_s,futex_count\n3,4\n")
    rates = tree_rates(spark, root)
    got = {(r.series_id, r.epoch_s): r.value for r in rates.collect()}
    run, wait, wake = "thread/5/51/sched/runtime_rate", "thread/5/52/futex/wait/5-0xab/futex_wait_rate", "thread/5/52/futex/wake/5-0xab/futex_count"
    assert [got[run, t] for t in range(1, 7)] == [0.0, 0.1, 0.05, 0.3, 0.8, 0.1]
    assert [got[wait, t] for t in range(1, 7)] == [0.0, 0.5, 0.0, 0.0, 0.0, 0.0]
    assert [got[wake, t] for t in range(1, 7)] == [0, 0, 4, 0, 0, 0]
    assert len(got) == 18
    target = spark.createDataFrame([(t, float(v)) for t, v in [(1, 1), (2, 3), (3, 2), (4, 5), (5, 9), (6, 3)]], "epoch_s long, target double")
    best = suspects(rates, target, k=1).first()
    assert best.series_id == run and best["corr"] > 0.9


def test_request_log_to_report(spark, tmp_path):
    put(str(tmp_path), "log.csv", "0,5,5\n0,15,15\n10,20,10\n")
    report = request_report(spark, str(tmp_path), 0.5, 10)
    assert rows(report) == [(0, 5, 2), (1, 10, 2), (2, 10, None)]


def test_threads_delete_only_what_they_settled(spark):
    """A block that ends in one thread leaves the tables that another thread settles meanwhile."""
    with settled_tables(spark):
        with ThreadPoolExecutor(1) as other:
            with settled_tables(spark):
                theirs = other.submit(lambda: settle(spark.range(5))).result()
                ours = settle(spark.range(7))
                assert ours.count() == 7
            assert theirs.count() == 5
            with pytest.raises(Exception, match="(?i)not.exist|not.found"):
                ours.count()
