import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from slowtrace import schemas
from slowtrace.functions import labels
from slowtrace.sources import constants, metric_files, requests as req, scrape, store, targets


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


@pytest.fixture()
def tree(tmp_path):
    root = str(tmp_path)
    put(root, "system-metrics/thread/5/51/sched/1.csv", "epoch_ms,runtime,rq_time\n1000,1.5,2\n2100,3,nan\n")
    put(root, "system-metrics/thread/5/51/futex/wait/27/5-0xab.csv", "futex_wait_ns,epoch_ms\n900,3001\n")
    put(root, "system-metrics/thread/5/52/ipc/sockets/27/ipv4_10.0.0.1:80.csv", "epoch_ms,socket_wait,count\n1000,7,2\n")
    put(root, "system-metrics/global/iowait/5/51/27/264241153.csv", "epoch_s,sector_cnt\n4,16\n")
    put(root, "system-metrics/global/epoll/ffff9a/streams/27/14_21.csv", "epoch_ms,stream_wait\n5000,9\n")
    return root


def test_tree_becomes_points(spark, tree):
    points = metric_files.metric_points(spark, tree)
    assert rows(points, "series_id", "epoch_s", "epoch_ms", "value") == [
        ("thread/5/51/sched/runtime", 1, 1000, 1.5), ("thread/5/51/sched/rq_time", 1, 1000, 2.0),
        ("thread/5/51/sched/runtime", 2, 2100, 3.0), ("thread/5/51/sched/rq_time", 2, 2100, None),
        ("thread/5/51/futex/wait/5-0xab/futex_wait_ns", 3, 3001, 900.0),
        ("thread/5/52/ipc/sockets/ipv4_10.0.0.1:80/socket_wait", 1, 1000, 7.0),
        ("thread/5/52/ipc/sockets/ipv4_10.0.0.1:80/count", 1, 1000, 2.0),
        ("global/5/51/global_iowait/264241153/sector_cnt", 4, None, 16.0),
        ("global/global_epoll/streams/ffff9a/14_21/stream_wait", 5, 5000, 9.0),
    ]
    assert {r[0] for r in rows(points, "part_seq")} == {1, 27}


def test_cells_may_be_quoted_or_not_numbers(spark, tmp_path):
    put(str(tmp_path), "system-metrics/thread/5/51/sched/1.csv",
        '"epoch_ms","runtime","note"\n"1000","1","a, ""b"""\n2000,2\nnan,3,x\ninf,4,\n')
    put(str(tmp_path), "system-metrics/thread/5/51/sched/2.csv", 'note,runtime,epoch_ms\nlate,5,3000,extra\n')
    points = metric_files.metric_points(spark, str(tmp_path))
    assert rows(points.filter("metric = 'runtime'"), "epoch_ms", "value") == [(1000, 1.0), (2000, 2.0), (3000, 5.0), (None, 3.0), (None, 4.0)]
    assert points.filter("metric = 'note'").count() == 5


def test_file_without_a_header_fails(spark, tmp_path):
    put(str(tmp_path), "system-metrics/thread/5/51/sched/1.csv", "1000,1\n2000,2\n")
    with pytest.raises(Exception, match="without a header"):
        metric_files.metric_points(spark, str(tmp_path)).collect()


def test_unexpected_path(spark, tree):
    put(tree, "system-metrics/thread/5/51/sched/notes.csv", "epoch_ms,runtime\n1,1\n")
    with pytest.raises(Exception, match="unexpected metric file path"):
        metric_files.metric_points(spark, tree).collect()
    assert metric_files.metric_points(spark, tree, on_error="skip").count() == 9
    kept = metric_files.metric_points(spark, tree, on_error="keep")
    assert kept.filter("malformed").count() == 1


def test_older_layout_names_the_command(spark, tmp_path):
    put(str(tmp_path), "system-metrics/redis-server/24/sched/1.csv", "epoch_ms,runtime\n1000,1\n")
    put(str(tmp_path), "system-metrics/iowait/jbd2/9/27/8388608.csv", "epoch_s,sector_cnt\n4,16\n")
    put(str(tmp_path), "system-metrics/epoll/ffff9a/sockets/27/h.csv", "epoch_ms,socket_wait\n4000,16\n")
    points = metric_files.metric_points(spark, str(tmp_path), layout="v1")
    assert rows(points, "series_id") == [
        ("thread/redis-server/24/sched/runtime",), ("global/jbd2/9/global_iowait/8388608/sector_cnt",),
        ("global/global_epoll/sockets/ffff9a/h/socket_wait",),
    ]


def test_selecting_series(spark):
    names = spark.createDataFrame([("thread/1/2/sched/runtime_rate",), ("thread/1/2/sched/sleep_time_rate",), ("thread/1/3/futex/x",)], "series_id string")
    kept = labels.select_series(names, r"sched/((?!sleep).*)_rate", exclude="/3/")
    assert rows(kept) == [("thread/1/2/sched/runtime_rate",)]
    assert names.select(labels.series_label(F.col("series_id"), r"thread/\d+/(\d+)/")).first()[0] == "2"


def test_constants(spark):
    given = spark.createDataFrame([("AF_INET", 2), ("sock_type_SOCK_RAW", 3), ("IPPROTO_TCP", 6), ("PID_FS_MAGIC", 9)], "identifier string, value long")
    assert rows(constants.build_consts(given)) == [("socket_family", "AF_INET", 2), ("socket_type", "SOCK_RAW", 3), ("family_protocol", "IPPROTO_TCP", 6)]


def test_targets_by_pid_or_name(spark):
    procs = spark.createDataFrame([(1, "(java)", 0), (2, "(kworker)", 0x00200000), (3, "(javac)", 4)], "pid long, comm string, flags long")
    assert rows(targets.select_targets(procs, name="^java"), "pid", "comm") == [(1, "java"), (3, "javac")]
    assert rows(targets.select_targets(procs, name=".*", kthread=True), "pid") == [(2,)]
    assert rows(targets.select_targets(procs, pids=[2, 3]), "pid") == [(2,), (3,)]
    for both in ({}, {"pids": [1], "name": "x"}):
        with pytest.raises(ValueError):
            targets.select_targets(procs, **both)


def test_scrape_sums_counters_and_takes_the_last_gauge(spark, tmp_path):
    put(str(tmp_path), "s1.txt", "\n".join([
        "# HELP experiment_producer_event_count n", 'experiment_producer_event_count{id="a"} 5',
        'experiment_producer_event_count{id="b"} 7', "experiment_producer_num_experiments 1",
        "experiment_producer_num_experiments 3", "other 99",
    ]))
    got = scrape.parse_scrapes(scrape.read_scrapes(spark, str(tmp_path)))
    assert rows(got, "total_events", "current_experiments") == [(12, 3)]


def test_request_logs(spark, tmp_path):
    put(str(tmp_path), "a/log.csv", "1,5,4\n2,9,7\n")
    assert rows(req.read_requests(spark, f"{tmp_path}/a")) == [(1, 5, 4), (2, 9, 7)]
    put(str(tmp_path), "b/log.csv", "start_epoch_us,end_epoch_us,response_time_us\n1,5,4\n")
    assert rows(req.read_requests(spark, f"{tmp_path}/b", "memtier")) == [(1, 5, 4)]
    put(str(tmp_path), "c/log.csv", "end_ts,duration_ms\n2024-05-19T13:08:15.671530744+00:00,12\n")
    got = req.read_requests(spark, f"{tmp_path}/c", "duration").first()
    assert str(got.end_ts) == "2024-05-19 13:08:15.671530" and got.duration_ms == 12


def test_target_files(spark, tmp_path):
    put(str(tmp_path), "p.csv", "epoch_s,delay_ms\n7,1.5\n")
    assert rows(req.read_target(spark, f"{tmp_path}/p.csv", "percentile")) == [(7, 1.5)]
    put(str(tmp_path), "u.csv", "epoch_s,users_count\n7.9,3\n")
    assert rows(req.read_target(spark, f"{tmp_path}/u.csv", "users")) == [(7, 3)]
    put(str(tmp_path), "t.csv", "user_count,epoch_ms\n4,1999\n")
    assert rows(req.read_target(spark, f"{tmp_path}/t.csv", "test_plan")) == [(1, 4)]
    put(str(tmp_path), "s.csv", "Time (seconds),Throughput (requests/second),95th Percentile Latency (microseconds)\n0,10.5,2500\n")
    assert rows(req.read_target(spark, f"{tmp_path}/s.csv", "samples")) == [(0, 10.5, 2.5)]


def _vfs(spark, secs):
    return spark.sql(" UNION ALL ".join(
        f"SELECT TIMESTAMP_NTZ'2025-04-11 23:59:{s:02d}.009116' + INTERVAL '{d}' DAY AS ts_s, 1L AS pid, 2L AS tid, 3L AS fs_magic, "
        f"0L AS device_id, CAST('18446635000000000000' AS DECIMAL(20,0)) AS inode_id, 0 AS op, {t}L AS {c}"
        for s, d, t, c in secs
    ))


def test_store_round_trip_and_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    first = _vfs(spark, [(1, 0, 100, "total_time"), (2, 0, 50, "total_time")]).withColumn("total_requests", F.lit(1))
    store.write_store({"vfs": first}, path, "r1")
    store.write_store({"vfs": first}, path, "r2")
    staged = _vfs(spark, [(1, 0, 7, "additional_time"), (3, 1, 9, "additional_time")])
    store.write_store({"vfs_staging": staged}, path, "r1")
    assert store.read_table(spark, path, "vfs").schema.names == [*schemas.VFS.names, "run_id", "day"]
    merged = str(tmp_path / "merged")
    store.merge_staged(spark, path, "vfs", merged)
    assert {r[0] for r in rows(spark.read.parquet(f"{merged}/vfs"), "run_id")} == {"r1"}
    for _ in range(2):
        # publishing again changes nothing
        store.publish_merged(spark, path, "vfs", merged)
        got = store.read_table(spark, path, "vfs")
        assert rows(got, "run_id", "day", F.second("ts_s"), "total_time", "total_requests", "hist0") == [
            ("r1", "2025-04-11", 1, 107, 1, None), ("r1", "2025-04-11", 2, 50, 1, None),
            ("r1", "2025-04-12", 3, 9, None, None), ("r2", "2025-04-11", 1, 100, 1, None),
            ("r2", "2025-04-11", 2, 50, 1, None),
        ]
        assert store.read_table(spark, path, "vfs_staging").isEmpty()
    names = store.register_views(spark, path, ["vfs"], run_id="r1")
    assert names == ["vfs"]
    assert spark.sql("SELECT count(*) FROM vfs WHERE inode_id = 18446635000000000000").first()[0] == 3


def test_rows_that_come_during_a_merge_stay(spark, tmp_path):
    path, merged = str(tmp_path / "store"), str(tmp_path / "merged")
    store.write_store({"vfs": _vfs(spark, [(1, 0, 100, "total_time")])}, path, "r1")
    store.write_store({"vfs_staging": _vfs(spark, [(1, 0, 7, "additional_time")])}, path, "r1")
    store.merge_staged(spark, path, "vfs", merged)
    store.write_store({"vfs": _vfs(spark, [(5, 0, 11, "total_time")])}, path, "r1")
    store.write_store({"vfs_staging": _vfs(spark, [(1, 0, 3, "additional_time")])}, path, "r1")
    store.publish_merged(spark, path, "vfs", merged)
    seconds = F.second("ts_s").alias("second")
    assert rows(store.read_table(spark, path, "vfs"), seconds, "total_time") == [(1, 107), (5, 11)]
    assert rows(store.read_table(spark, path, "vfs_staging"), "additional_time") == [(3,)]
    again = str(tmp_path / "again")
    store.merge_staged(spark, path, "vfs", again)
    store.publish_merged(spark, path, "vfs", again)
    assert rows(store.read_table(spark, path, "vfs"), seconds, "total_time") == [(1, 110), (5, 11)]
    # nothing staged: nothing changes
    store.merge_staged(spark, path, "vfs", again)
    store.publish_merged(spark, path, "vfs", again)
    assert store.read_table(spark, path, "vfs").count() == 2


def test_overwrite_replaces_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    for t in (1, 2):
        store.write_table(_vfs(spark, [(1, 0, t, "total_time"), (1, 1, t, "total_time")]), path, "vfs", "r1")
    store.write_table(_vfs(spark, [(1, 0, 9, "total_time")]), path, "vfs", "r1", mode="overwrite")
    assert rows(store.read_table(spark, path, "vfs"), "day", "total_time") == [
        ("2025-04-11", 9), ("2025-04-12", 1), ("2025-04-12", 2),
    ]


def test_store_prunes_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store({"vfs": _vfs(spark, [(1, 0, 1, "total_time")])}, path, "r1")
    df = store.read_table(spark, path, "vfs").filter("run_id = 'r1'").select("total_time")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plan.split("ReadSchema: ")[1].strip() == "struct<total_time:bigint>"


def test_every_table_of_the_store_can_be_written_and_viewed(spark, tmp_path):
    path = str(tmp_path / "store")
    for name, schema in schemas.TABLES.items():
        store.write_table(spark.createDataFrame([tuple(None for _ in schema)], schema), path, name, "r")
    names = store.register_views(spark, path)
    assert set(names) == {t for t in schemas.TABLES if not t.endswith("_staging")} | {"taskstats_view"}
    assert len(names) == 12
