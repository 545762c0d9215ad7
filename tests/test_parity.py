"""Series, quantiles and correlations against pandas and numpy on small random frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slowtrace.operators import correlate as co, latency, series


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(3)
    parts = []
    for name in ("a", "b", "c"):
        epochs = np.sort(rng.choice(np.arange(100, 160), 25, replace=False))
        parts.append(pd.DataFrame({
            "series_id": name, "epoch_s": epochs, "epoch_ms": epochs * 1000 + rng.integers(0, 999, 25),
            "value": np.cumsum(rng.integers(0, 5_000_000, 25)).astype(float),
        }))
    return pd.concat(parts, ignore_index=True)


def dense(sparse):
    """Wide pandas frames of value and clock over the whole calendar."""
    index = pd.RangeIndex(sparse.epoch_s.min(), sparse.epoch_s.max() + 1, name="epoch_s")
    return [sparse.pivot(index="epoch_s", columns="series_id", values=c).reindex(index) for c in ("value", "epoch_ms")]


def wide(df):
    return df.toPandas().pivot(index="epoch_s", columns="series_id", values="value")


def close(got, want):
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_names=False, check_freq=False, rtol=1e-9)


@pytest.mark.parametrize("leading", [False, True])
def test_wait_rate(spark, sparse, leading):
    value, clock = dense(sparse)
    value = value.ffill()
    if leading:
        value = value.fillna(0)
    clock = clock.apply(lambda c: c.fillna(pd.Series(c.index * 1000, index=c.index)))
    want = ((value / 1e6).diff() / clock.diff()).fillna(0)
    close(wide(series.wait_rate(spark.createDataFrame(sparse), leading_zero=leading, cell_rows=7)), want)


def test_sched_rate(spark, sparse):
    value, clock = dense(sparse)
    want = (value.interpolate().diff() / clock.interpolate().diff()).fillna(0)
    close(wide(series.sched_rate(spark.createDataFrame(sparse), cell_rows=7)), want)


def test_fills(spark, sparse):
    value, _ = dense(sparse)
    points = spark.createDataFrame(sparse)
    close(wide(series.fill_forward(points)), value.ffill())
    close(wide(series.interpolate(points, cell_rows=None)), value.interpolate())
    close(wide(series.fill_zero(points)), value.fillna(0))


def test_calendar_per_frame(spark, sparse):
    two = pd.concat([sparse.assign(run_id="r1"), sparse.query("epoch_s < 130").assign(run_id="r2")])
    got = series.densify(spark.createDataFrame(two), ["run_id", "series_id"], frame=["run_id"]).toPandas()
    for run, rows in two.groupby("run_id"):
        own = got[got.run_id == run]
        assert own.epoch_s.min() == rows.epoch_s.min() and own.epoch_s.max() == rows.epoch_s.max()
        assert len(own) == 3 * (rows.epoch_s.max() - rows.epoch_s.min() + 1)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation(spark, method):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({f"s{i}": rng.integers(0, 8, 60).astype(float) for i in range(4)})
    frame["flat"] = 1.0
    frame["target"] = rng.integers(0, 6, 60).astype(float)
    frame.loc[rng.choice(60, 9, replace=False), "s1"] = np.nan
    frame.loc[rng.choice(60, 9, replace=False), "target"] = np.nan
    want = frame.corr(method=method)["target"].drop("target").dropna()
    frame["epoch_s"] = range(60)
    long = frame.drop(columns="target").melt("epoch_s", var_name="series_id").dropna()
    target = frame[["epoch_s", "target"]]  # NaN is as good as missing
    got = co.correlate(spark.createDataFrame(long), spark.createDataFrame(target), method).toPandas()
    assert dict(zip(got.series_id, got["corr"])) == pytest.approx(want.to_dict())


def test_active_at_ticks_percentiles(spark):
    rng = np.random.default_rng(9)
    start = rng.integers(0, 300, 120)
    log = pd.DataFrame({"start": start, "end": start + rng.integers(0, 90, 120)})
    log["duration"] = log.end - log.start
    got = latency.response_percentiles(spark.createDataFrame(log), 0.9, 10).toPandas().set_index("epoch_s").percentile_value
    ticks = range(log.start.min(), log.end.max() + 10, 10)
    want = {t: log[(log.start <= t) & (log.end > t - 10)].duration.quantile(0.9) for t in ticks}
    assert got.sort_index().to_dict() == pytest.approx(want, nan_ok=True)
    each = latency.response_percentiles(spark.createDataFrame(log), 0.9, 1, inclusive_end=True).toPandas()
    each = each.set_index("epoch_s").percentile_value
    want = {t: log[(log.start <= t) & (log.end >= t)].duration.quantile(0.9) for t in range(log.start.min(), log.end.max() + 1)}
    assert each.sort_index().to_dict() == pytest.approx(want, nan_ok=True)


def test_histogram2d(spark):
    rng = np.random.default_rng(11)
    points = pd.DataFrame({"epoch_s": rng.integers(50, 70, 400), "value": rng.random(400).round(3)})
    kept = points[points.value > 0]
    low, high = kept.epoch_s.min(), kept.epoch_s.max()
    want, _, _ = np.histogram2d(kept.epoch_s, kept.value, bins=[high - low, 10])
    got = np.zeros_like(want)
    for r in co.histogram2d(spark.createDataFrame(points)).collect():
        got[r.x_bin, r.y_bin] = r.n
    assert (got == want).all()


def test_response_times_truncate_toward_zero(spark):
    log = spark.sql("SELECT TIMESTAMP_NTZ'2024-05-19 13:08:15.67' AS end_ts, 1500 AS duration_ms")
    row = latency.load_response_times(log).first()
    assert (row.end_epoch_s, row.duration_s, row.start_epoch_s) == (1716124095, 1.5, 1716124093)


def test_counter_throughput(spark):
    target = pd.DataFrame({"epoch_s": [1, 2, 4], "total_events": [10, 30, 90], "experiment_count": [1, 2, 2]})
    got = series.counter_throughput(spark.createDataFrame(target)).orderBy("epoch_s").collect()
    assert [(r.throughput, r.ideal) for r in got] == [(None, 10_000), (20.0, 20_000), (30.0, 20_000)]


def test_outer_join_keeps_both_sides(spark):
    points = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "series_id string, epoch_s long, value double")
    target = spark.createDataFrame([(2, 9.0), (3, 8.0)], "epoch_s long, target double")
    got = series.join_target(points, target)
    want = points.join(target, "epoch_s", "full")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_wide_frame(spark):
    points = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0), ("a", 2, 2.0), ("x", 9, 0.0)], "series_id string, epoch_s long, value double")
    got = series.align_wide(points, ["a", "b"]).orderBy("epoch_s").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 5.0), (2, 2.0, None)]


def test_derived_sleep_and_gate(spark):
    data = [(1, 1, m, 5, v) for m, v in [("runtime_rate", 0.2), ("rq_time_rate", 0.1), ("block_time_rate", 0.3), ("sleep_time_rate", 0.0)]]
    rates = spark.createDataFrame(data, "pid long, tid long, metric string, epoch_s long, value double")
    assert series.derived_sleep(rates).first().sleep_share == pytest.approx(0.4)
    assert series.derived_sleep(rates, gate="sleep_time_rate").first().sleep_share == 0
    row = series.combined_rates(rates).first()
    assert (row.runnable, row.active_rate) == (pytest.approx(0.3), pytest.approx(0.6))


def test_sum_over_series_fills_missing_with_zero(spark):
    points = spark.createDataFrame([("h", "a", 1, 1.0), ("h", "b", 1, 2.0), ("h", "b", 2, 4.0)], "host string, series_id string, epoch_s long, value double")
    got = {r.epoch_s: r.value for r in series.sum_series(points, ["host"]).collect()}
    assert got == {1: 3.0, 2: 4.0}
    assert points.agg(F.count("*")).first()[0] == 3
