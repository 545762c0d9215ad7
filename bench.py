"""Seconds per headline query. Prints one JSON line.

BENCH_SF_DIR: folder of the tables, BENCH_CPUS: cores, BENCH_QUERIES: name prefixes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slowtrace.plans import catalog  # noqa: E402
from slowtrace.session import build_session, provide_shared_dir, settled_tables  # noqa: E402

HEADLINE = [
    "w1_task_state_shares", "w8_split_by_bucket", "a1_io_stats", "a2_call_stats", "j7_merge_pending",
    "j4_pair_events", "j5_intersect_intervals", "a3_wake_stats", "a4_muxio_wait", "a5_muxio_file_wait",
    "a6_device_share", "a7_global_io_share", "a9_response_percentiles", "a10_response_percentiles_hdr",
    "a11_throughput", "a12_pearson", "a13_spearman", "a14_active_series_median", "a15_histogram2d",
    "j1_align_wide", "j2_densify", "j3_join_target", "w2_wait_rate", "w3_sched_rate", "w5_dedupe_first",
    "a8_sum_series", "j9_wait_wake_product", "j11_wakers_of", "j13_enrich_sockets", "j14_discover",
    "s2_parse_metric_path", "p6_render_inet",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    prefixes = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    provide_shared_dir(spark)
    queries = catalog.queries()
    names = [n for n in (queries if prefixes else HEADLINE) if not prefixes or any(n.startswith(p) for p in prefixes)]
    # the first job of a session pays for starting up; it is not part of any query
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        with settled_tables(spark):
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
