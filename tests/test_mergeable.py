"""Covering nodes of intervals, stored histograms and stored sketches."""

import random

import pytest
from pyspark.sql import functions as F

from slowtrace.operators import intervals as iv, latency, relations

rng = random.Random(11)
REQUESTS = "g string, end long, duration long"


def test_covering_nodes_hold_each_cell_once(spark):
    spans = [(0, 0), (0, 1023), (1, 1022), (-7, 9), (-5, -5), (2 ** 40 + 3, 2 ** 40 + 700)]
    spans += [(a, a + rng.randrange(300)) for a in (rng.randrange(-400, 400) for _ in range(60))]
    df = spark.createDataFrame(spans, "a long, b long")
    for row in df.withColumn("nodes", iv.covering_nodes("a", "b")).collect():
        cells = sorted(c for level, node in row.nodes for c in range(node << level, (node + 1) << level))
        assert cells == list(range(row.a, row.b + 1))
        assert len(row.nodes) <= 2 * (row.b - row.a + 1).bit_length()


def plain(left, right):
    return sorted((a, b, max(s, u), min(e, v)) for a, g, s, e in left for b, h, u, v in right
                  if g is not None and g == h and s < v and u < e)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_pairs_meet_once(spark, width):
    """Empty and equal intervals, shared borders, times before zero, a hot key, a NULL key."""
    def side(n, first):
        out = []
        for i in range(n):
            start = rng.randrange(-300, 300)
            out.append((first + i, rng.choice(["hot", "hot", "b", None]), start, start + rng.choice([0, 1, 2, 13, 200, 500])))
        return out + [(first + n + i, "hot", s, e) for i, (s, e) in enumerate([(0, 7), (7, 14), (0, 7), (3, 3), (-300, 800)])]

    left, right = side(60, 0), side(70, 1000)
    a = spark.createDataFrame(left, "a long, g string, a_start long, a_end long")
    b = spark.createDataFrame(right, "b long, g string, b_start long, b_end long")
    got = iv.intersect_intervals(a, b, ["g"], width).select("a", "b", "start", "end").collect()
    assert sorted(map(tuple, got)) == plain(left, right)
    assert iv.intersect_intervals(a.limit(0), b, ["g"], width).isEmpty()
    assert iv.intersect_intervals(a, b.limit(0), ["g"], width).isEmpty()


def test_long_intervals_cost_logarithms(spark):
    """Intervals over a thousand cells: rows to join grow with their logarithm, and no pair meets in vain."""
    left = spark.range(50).selectExpr("id a", "1 g", "id * 3 a_start", "id * 3 + 10000 a_end")
    right = spark.range(50).selectExpr("id b", "1 g", "id * 5 b_start", "id * 5 + 9000 b_end")
    bounds = ("a_start", "a_end"), ("b_start", "b_end")
    one = iv._met_by_points(left, right, *bounds, 10, 0)
    two = iv._met_by_points(right, left, bounds[1], bounds[0], 10, 1)
    assert one.count() <= 50 * (2 * 10 + 10)
    met = one.join(two, ["g", "__role", "__level", "__node"])
    assert iv.intersect_intervals(left, right, ["g"], 10).count() == 2500
    assert met.select("a", "b").distinct().count() == 2500 and met.count() <= 1.2 * 2500


def test_inverted_interval_fails(spark):
    a = spark.createDataFrame([(1, 5, 3)], "g int, a_start long, a_end long")
    b = spark.createDataFrame([(1, 0, 9)], "g int, b_start long, b_end long")
    with pytest.raises(Exception, match="ends before it starts"):
        iv.intersect_intervals(a, b, ["g"], 10).collect()


def test_stored_histograms_add_up(spark):
    """Histograms of narrow ticks, added, are those of wide ticks; quantiles are slots of the right requests."""
    rows = [(rng.choice("ab"), rng.randrange(-500, 500), int(rng.lognormvariate(6, 2))) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("a", None, 4), ("a", 3, None)], REQUESTS)
    merged = latency.merged_histograms(latency.tick_histograms(df, 10, ["g"]), 100, ["g"])
    whole = latency.tick_histograms(df, 100, ["g"])
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()
    groups = {}
    for g, end, duration in rows:
        groups.setdefault((g, end // 100 * 100), []).append(duration)
    got = latency.histogram_quantiles(merged, [0, 0.5, 0.999], ["g"]).collect()
    assert {(r.g, r.tick): r.total for r in got} == {k: len(v) for k, v in groups.items()}
    for r in got:
        values = sorted(groups[r.g, r.tick])
        for q, slot in ((0, r.p0), (0.5, r.p50), (0.999, r.p99_9)):
            exact = values[max(-(-int(q * 1000) * len(values) // 1000), 1) - 1]
            assert exact <= slot <= exact * (1 + 1 / 128) + 1


def test_negative_duration_and_no_requests(spark):
    assert latency.tick_histograms(spark.createDataFrame([], REQUESTS), 10).isEmpty()
    with pytest.raises(Exception, match="negative duration"):
        latency.tick_histograms(spark.createDataFrame([("a", 1, -1)], REQUESTS), 10).collect()


def test_sketches_are_united_over_time_and_parents(spark):
    """A child seen in many buckets and parents counts once; the error stays within four standard errors."""
    points = spark.range(60_000).selectExpr("id % 3 pid", "id % 20000 child", "id - 30000 t")
    stored = relations.inventory_sketches(points, ["pid"], "child", "t", 1000)
    assert stored.select(F.max(F.octet_length("sketch"))).first()[0] <= 2 ** 12 + 64
    whole = relations.inventory_estimates(stored, [], 10 ** 6, "child").collect()
    total = {r.bucket: r.n_child for r in whole}
    assert total.keys() == {-10 ** 6, 0} and all(abs(n - 20_000) <= 0.065 * 20_000 for n in total.values())
    few = spark.createDataFrame([(1, 5, 0), (1, 5, 9), (1, None, 3), (1, 6, 4), (None, 7, 4)], "pid long, child long, t long")
    got = relations.inventory_estimates(relations.inventory_sketches(few, ["pid"], "child", "t", 5), ["pid"], 10).collect()
    assert {r.pid: r.n_children for r in got} == {1: 2, None: 1}
