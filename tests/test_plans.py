"""What the plans of the batch operators may and may not contain."""

import re

import pytest

from slowtrace.operators import intervals as iv, series
from slowtrace.plans import catalog
from slowtrace.plans.bindings import DAY, HOUR, counter, events, intervals, per_epoch, requests

SF = "/root/testdata/sf0.001"

#: Queries that run jobs of their own while they are built (streams, loops, written files).
EAGER = re.compile(r"^(t\d|s11|s1_|s4|s5|s7|j14|a5)")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: plan_of(fn(spark, SF)) for name, fn in catalog.queries().items() if not EAGER.match(name)
    }


def test_no_theta_joins(plans):
    for name, plan in plans.items():
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_no_python_in_batch_operators(plans):
    for name, plan in plans.items():
        assert not re.search(r"Python|Pandas|Arrow", plan), name


def test_scans_read_only_what_they_need(plans):
    for name in ("a3_wake_stats", "a12_pearson", "a11_throughput"):
        for schema in re.findall(r"ReadSchema: struct<(.*?)>", plans[name]):
            assert "event_id" not in schema and "props" not in schema or name == "a3_wake_stats", name
    assert "l_extendedprice" not in plans["a6_device_share"]


def test_filters_reach_the_scan(plans):
    assert "EqualTo(event_type,error)" in plans["a3_wake_stats"]
    assert "In(event_type" in plans["j4_pair_events"]


def test_windows_over_rows_are_cut_by_cell(spark):
    """A window on raw rows partitions by (key, cell); only per-cell summaries use the key alone."""
    log = events(spark, SF)
    for df in (
        iv.pair_events(log, ["user_id"], "click", "purchase", kind="event_type", ts="t", cell_width=DAY),
        series.wait_rate(counter(spark, SF), ["user_id"], step=6 * 3600),
        series.diff(log, ["user_id"], value="cents", order="t", cell_width=DAY),
    ):
        for line in plan_of(df).splitlines():
            if " Window " in line or line.strip().startswith("+- Window"):
                assert "__cell" in line, line


def test_slicing_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(iv.split_by_bucket(intervals(spark, SF), HOUR))


def test_statistics_take_one_shuffle_after_partial_aggregation(plans):
    for name in ("a1_io_stats", "a2_call_stats", "a3_wake_stats"):
        assert plans[name].count("Exchange hashpartitioning") == 1, name
        assert "partial_" in plans[name], name


def test_filling_gaps_does_not_shuffle_the_filled_rows(spark):
    """All exchanges lie below the Generate that grows the filler rows."""
    plan = plan_of(series.densify(per_epoch(spark, SF, HOUR, "user_id"), ["user_id"], step=3600))
    lines = plan.splitlines()
    first_generate = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[:first_generate])


def test_active_requests_are_exploded_not_joined(spark):
    plan = plan_of(iv.active_at_ticks(requests(spark, SF), HOUR))
    assert "Generate explode" in plan and "Join" not in plan
