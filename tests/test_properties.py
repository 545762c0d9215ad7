"""What must hold on any data."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from slowtrace.operators import accounting, correlate as co, intervals as iv, relations
from slowtrace.operators.discovery import discover
from slowtrace.operators.shares import device_share, taskstats_view
from slowtrace.plans.accounting_queries import poll_events, sector_samples, taskstats
from slowtrace.plans.bindings import DAY, HOUR, events, intervals, per_epoch
from slowtrace.plans.relation_queries import accesses

SF = "/root/testdata/sf0.001"
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.tuples(st.integers(-10_000, 10_000), st.integers(0, 9_000)), min_size=1, max_size=12), st.integers(1, 700))
def test_slices_add_up_to_the_interval(spark, spans, bucket):
    data = [(i, a, a + n) for i, (a, n) in enumerate(spans)]
    df = spark.createDataFrame(data, "id long, start long, end long")
    got = dict(iv.split_by_bucket(df, bucket, touch_end=True).groupBy("id").agg(F.sum("slice")).collect())
    assert got == {i: b - a for i, a, b in data}


def test_histogram_adds_up_to_the_requests(spark):
    stats = accounting.call_stats(intervals(spark, SF), ["event_type"], HOUR)
    hist = sum((F.col(f"hist{i}") for i in range(1, 8)), F.col("hist0"))
    assert stats.filter("total_requests IS NOT NULL").filter(hist != F.col("total_requests")).isEmpty()
    total = stats.agg(F.sum("total_requests"), F.sum("total_time")).first()
    want = intervals(spark, SF).agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    assert tuple(total) == tuple(want)


def test_shares_are_between_zero_and_one(spark):
    view = taskstats_view(taskstats(spark, SF))
    shares = ["run_share", "rq_share", "uninterruptible_share", "interruptible_share"]
    whole = sum((F.col(c) for c in shares[1:]), F.col(shares[0]))
    calm = view.filter(F.col("interruptible_share") > 0)
    assert calm.count() > 0
    assert calm.filter(F.abs(whole - 1) > 1e-9).isEmpty()
    assert view.filter(" OR ".join(f"{c} < 0" for c in shares)).isEmpty()


def test_device_shares_add_up(spark):
    sums = device_share(sector_samples(spark, SF), ["tid"]).groupBy("epoch_s", "device").agg(F.sum("share").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_histogram_rows_add_up(spark):
    cells = co.histogram2d(per_epoch(spark, SF, DAY, "user_id"), x_bins=15)
    sums = cells.groupBy("x_bin").agg(F.sum("frequency").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    assert cells.agg(F.max("y_bin"), F.max("x_bin")).first()[0] <= 9


def test_peer_map_is_symmetric(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (3, 4), (5, 5)], "sock1_inode_id long, sock2_inode_id long")
    peers = relations.peer_map(pairs)
    flipped = peers.select(F.col("sock2_inode_id").alias("sock1_inode_id"), F.col("sock1_inode_id").alias("sock2_inode_id"))
    assert peers.exceptAll(flipped).isEmpty() and peers.count() == 5


def test_discovery_grows_with_the_seeds(spark):
    acc = accesses(spark, SF).persist()
    one = spark.createDataFrame([(3,)], "pid long")
    two = spark.createDataFrame([(3,), (7,)], "pid long")
    small = {r.pid: r.discovered_at for r in discover(acc, one)[0].collect()}
    large = {r.pid: r.discovered_at for r in discover(acc, two)[0].collect()}
    assert set(small) <= set(large)
    assert all(large[p] <= at for p, at in small.items())


def test_intersections_lie_in_both_intervals_and_appear_once(spark):
    log = intervals(spark, SF).withColumn("g", F.col("user_id") % 3)
    a = log.filter("event_type = 'view'").select("g", F.col("event_id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = log.filter("event_type = 'click'").select("g", F.col("event_id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    wide = iv.intersect_intervals(a, b, ["g"], 40 * DAY)
    fine = iv.intersect_intervals(a, b, ["g"], HOUR // 7)
    assert fine.filter("start < a_start OR start < b_start OR end > a_end OR end > b_end OR start >= end").isEmpty()
    assert fine.count() == fine.select("a", "b").distinct().count()
    assert wide.exceptAll(fine).isEmpty() and fine.exceptAll(wide).isEmpty()


@pytest.mark.parametrize("k,offset", [(3, 0), (3, 2)])
def test_top_k_is_a_slice_of_the_order(spark, k, offset):
    order = [F.col("cents").desc(), F.col("event_id")]
    whole = [r.event_id for r in events(spark, SF).orderBy(*order).collect()]
    assert [r.event_id for r in co.top_k(events(spark, SF), order, k, offset).collect()] == whole[offset:offset + k]


def test_poll_binding_has_all_kinds(spark):
    kinds = {r.kind for r in poll_events(spark, SF).select("kind").distinct().collect()}
    assert kinds == {"epoll_start", "epoll_end", "epoll_insert", "epoll_remove"}
