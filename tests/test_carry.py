"""Carried windows and positions equal the plain ones, also for a key with a third of all rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from slowtrace.operators.carry import with_balanced_cells, with_last_known, with_neighbours, with_running_sum
from slowtrace.operators.ranges import explode_range, time_cell, value_cell
from slowtrace.operators.ranking import avg_rank, quantile

rng = random.Random(3)


@pytest.fixture(scope="module", params=[False, True], ids=["keys", "null_key"])
def log(spark, request):
    rnd = random.Random(7)
    data = []
    for i in range(1500):
        key = 0 if rnd.random() < 0.34 else rnd.randint(1, 12)
        key = None if request.param and key == 5 else key
        data.append((key, rnd.randint(-5000, 100_000), i, rnd.randint(0, 9), rnd.choice([None, rnd.randint(0, 50)])))
    return spark.createDataFrame(data, "k int, t long, seq long, v long, maybe long").cache()


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_neighbours(log):
    args = (["k"], ["t", "seq"])
    taken = {"previous": {"p": "v", "pt": "t"}, "following": {"n": "v", "nm": "maybe"}}
    same(
        with_neighbours(log, *args, time_cell(F.col("t"), 500), **taken),
        with_neighbours(log, *args, None, **taken),
    )


@pytest.mark.parametrize("following", [False, True])
def test_last_known(log, following):
    args = (["k"], ["t", "seq"], {"m": "maybe"})
    same(
        with_last_known(log, *args, time_cell(F.col("t"), 500), following),
        with_last_known(log, *args, None, following),
    )


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sum(log, inclusive):
    args = (["k"], ["t", "seq"], {"s": "v"})
    same(
        with_running_sum(log, *args, time_cell(F.col("t"), 500), inclusive, {"all": "v"}),
        with_running_sum(log, *args, None, inclusive, {"all": "v"}),
    )


def test_no_task_gets_a_whole_hot_key(log):
    cells = log.filter("k = 0").groupBy(time_cell(F.col("t"), 500)).count().agg(F.max("count")).first()[0]
    assert cells < log.filter("k = 0").count() / 10


def test_value_cell_never_decreases(spark):
    values = [float("-inf"), -1e300, -5.0, -1.0, -1e-9, 0.0, 5e-324, 1e-9, 0.1, 0.5, 1.0, 1.0000001, 2.0, 255.0, 1e9, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = [r[1] for r in df.select("v", value_cell(F.col("v"))).orderBy("v").collect()]
    assert cells == sorted(cells) and None not in cells


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_equals_builtin(log, q):
    ours = quantile(log, ["k"], "t", q, "x")
    theirs = log.groupBy("k").agg(F.percentile("t", q).alias("y"))
    for row in ours.join(theirs, "k").collect():
        assert row.x == pytest.approx(row.y)


def test_disc_quantile_is_a_value(log):
    ours = {r.k: r.x for r in quantile(log, ["k"], "v", 0.5, "x", kind="disc").collect()}
    for r in log.groupBy("k").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("y")).collect():
        assert ours[r.k] == r.y


def test_avg_rank_shares_ties(log):
    rank = F.rank().over(Window.partitionBy("k").orderBy("v"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("k", "v"))
    want = log.select("seq", (rank + (ties - 1) / 2.0).alias("rank"))
    same(avg_rank(log, ["k"], "v").select("seq", "rank"), want)


def test_explode_range_skips_empty_and_crosses_chunks(spark):
    df = spark.createDataFrame([(1, 5, 4), (2, -3, 2), (3, 4000, 9000), (4, 7, 7)], "id int, a long, b long")
    got = explode_range(df, F.col("a"), F.col("b"), "n").groupBy("id").agg(
        F.min("n"), F.max("n"), F.count("n"), F.count_distinct("n")
    )
    assert sorted(map(tuple, got.collect())) == [(2, -3, 2, 6, 6), (3, 4000, 9000, 5001, 5001), (4, 7, 7, 1, 1)]


def burst(n):
    """A hot key with nearly all its rows in one second of a day, the key NULL, light keys, equal times, no times."""
    times = [rng.randrange(86_400_000_000) for _ in range(n // 10)] + [3_600_000_000 + rng.randrange(1_000_000) for _ in range(n)]
    rows = [("hot", t) for t in times] + [(None, t) for t in times[:n // 2]] + [("light", t) for t in times[:50]]
    return rows + [("hot", 3_600_000_000)] * 7 + [("hot", None)] * 3 + [("tie", 5)] * (n // 3)


def test_balanced_cells_hold_about_so_many_rows(spark):
    """A burst is cut as finely as the rest; cells never decrease along the time."""
    df = spark.createDataFrame(burst(20_000), "k string, t long")
    cut = with_balanced_cells(df, ["k"], "t", 1_000)
    assert cut.count() == df.count()
    sizes = {(r.k, r.cell): (r.n, r.low, r.high) for r in cut.groupBy("k", F.col("__balanced").alias("cell")).agg(
        F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect()}
    assert all(n <= 2_000 for (k, _), (n, _, _) in sizes.items() if k != "tie")
    assert len([k for k, _ in sizes if k == "hot"]) == 23 and [c for k, c in sizes if k == "light"] == [0]
    hot = [sizes["hot", c] for c in range(23)]
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))


def test_neighbours_over_balanced_cells_are_those_of_the_plain_window(spark):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(burst(900))], "k string, t long, i long")
    plain = with_neighbours(df, ["k"], ["t", "i"], None, previous={"p": "i"})
    cut = with_neighbours(with_balanced_cells(df, ["k"], "t", 40), ["k"], ["t", "i"], F.col("__balanced"), previous={"p": "i"})
    cut = cut.drop("__balanced")
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()
    empty = with_balanced_cells(df.limit(0), ["k"], "t", 40)
    assert empty.isEmpty() and empty.columns == [*df.columns, "__balanced"]
