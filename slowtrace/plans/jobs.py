"""The three ways in: raw logs → store, metric tree → suspects, request log → report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowtrace.functions.addresses import render_inet, socket_context
from slowtrace.functions.labels import series_id
from slowtrace.functions.scalars import FUTEX_WAIT, FUTEX_WAKE, normalize_futex_op
from slowtrace.functions.timebase import NS_PER_S, boot_to_epoch, ns_to_timestamp
from slowtrace.operators import accounting, multiplex
from slowtrace.operators.correlate import correlate, top_k
from slowtrace.operators.intervals import open_events, pair_events
from slowtrace.operators.latency import response_percentiles_hdr, throughput
from slowtrace.operators.relations import peer_map
from slowtrace.operators.series import dedupe_first, derive_rates
from slowtrace.sources import store
from slowtrace.sources.constants import build_consts
from slowtrace.sources.metric_files import metric_points
from slowtrace.sources.requests import read_requests

_THREAD = ["pid", "tid"]
_LOCK = ["futex_key_addr", "futex_key_word", "futex_key_offset"]
_FILE = ["fs_magic", "device_id", "inode_id"]


@dataclass
class RawLogs:
    """Event logs of one run; times in boot nanoseconds. Logs that are missing are skipped.

    Task snapshots may also come with ``ts`` as a timestamp, which is taken as it is.

    ``calls`` and ``futex`` have ``kind`` start/end by thread, ``block_io`` by request;
    ``futex`` has ``op`` and ``ret``, ``muxio`` the events of ``operators.multiplex``.
    """

    taskstats: DataFrame | None = None
    calls: DataFrame | None = None
    futex: DataFrame | None = None
    block_io: DataFrame | None = None
    muxio: DataFrame | None = None
    sockets: DataFrame | None = None
    peers: DataFrame | None = None
    identifiers: DataFrame | None = None


def _calls(events: DataFrame, payload: list[str], horizon: int | None) -> DataFrame:
    """Calls by thread; with a ``horizon`` also those still open at the end of the log, their ``end`` NULL."""
    order = ["ts", "seq"]
    done = pair_events(events, _THREAD, "start", "end", order=order, payload=payload)
    if horizon is None:
        return done
    return done.unionByName(
        open_events(events, _THREAD, "start", "end", order=order, payload=payload), allowMissingColumns=True
    )


def build_tables(logs: RawLogs, boot_offset_ns: int = 0, horizon: int | None = None) -> dict[str, DataFrame]:
    """Every table of the store the given logs can fill."""
    tables: dict[str, DataFrame] = {}

    def stamped(stats: DataFrame) -> DataFrame:
        # the second is floored on the boot clock, then shifted
        return stats.withColumn("ts_s", ns_to_timestamp(F.col("bucket") + F.lit(boot_offset_ns))).drop("bucket")

    if logs.taskstats is not None:
        boot = dict(logs.taskstats.dtypes)["ts"] in ("bigint", "int")
        shifted = ns_to_timestamp(boot_to_epoch(F.col("ts"), boot_offset_ns))
        tables["taskstats"] = logs.taskstats.withColumn("ts", shifted) if boot else logs.taskstats
    if logs.calls is not None:
        done = _calls(logs.calls, [*_FILE, "op"], horizon)
        tables["vfs"] = stamped(accounting.call_stats(done, [*_THREAD, *_FILE, "op"], NS_PER_S, horizon))
    if logs.futex is not None:
        known = logs.futex.withColumn("op", normalize_futex_op(F.col("op"))).filter(F.col("op").isNotNull())
        waits = _calls(known.filter(F.col("op") == FUTEX_WAIT), _LOCK, horizon)
        wakes = known.filter((F.col("op") == FUTEX_WAKE) & (F.col("kind") == "end"))
        tables["futex_wait"] = stamped(accounting.call_stats(waits, [*_THREAD, *_LOCK], NS_PER_S, horizon))
        tables["futex_wake"] = stamped(accounting.wake_stats(wakes, [*_THREAD, *_LOCK], NS_PER_S))
    if logs.block_io is not None:
        done = pair_events(
            logs.block_io, ["part0", "sector", "op"], "start", "end", order=["ts", "seq"],
            payload=[*_THREAD, "bdev", "size"],
        )
        tables["iowait"] = stamped(accounting.io_stats(done, [*_THREAD, "part0", "bdev"], NS_PER_S))
    if logs.muxio is not None:
        tables["muxio_wait"] = stamped(multiplex.muxio_wait(logs.muxio, NS_PER_S, horizon))
        tables["muxio_file_wait"] = stamped(multiplex.muxio_file_wait(logs.muxio, NS_PER_S, horizon))
    if logs.sockets is not None:
        tables["socket_context"] = socket_context(logs.sockets)
        tables["socket_inet"] = render_inet(logs.sockets)
    if logs.peers is not None:
        tables["socket_map"] = peer_map(logs.peers)
    if logs.identifiers is not None:
        tables["linux_consts"] = build_consts(logs.identifiers)
    return tables


def store_run(
    spark: SparkSession, logs: RawLogs, path: str, run_id: str, boot_offset_ns: int = 0, horizon: int | None = None
) -> list[str]:
    """Account the logs of a run, store the tables and register them as views.

    With a ``horizon`` (boot ns, the end of the log) open calls count up to it.
    """
    tables = build_tables(logs, boot_offset_ns, horizon)
    store.write_store(tables, path, run_id)
    return store.register_views(spark, path, list(tables), run_id)


def tree_rates(
    spark: SparkSession, root: str, layout: str = "v2", interval: tuple[int, int] | None = None
) -> DataFrame:
    """A metric tree as aligned, gap-free rates by series."""
    points = metric_points(spark, root, layout)
    unique = dedupe_first(
        points.select("series_id", "scope", "pid", "tid", "comm", "metric_class", "ipc_type", "resource", "metric",
                      "part_seq", "epoch_s", "epoch_ms", "value")
    ).drop("series_id")
    return derive_rates(unique, interval=interval).withColumn("series_id", series_id())


def suspects(
    rates: DataFrame, target: DataFrame, k: int = 20, method: str = "spearman", min_abs: float | None = None
) -> DataFrame:
    """The ``k`` series that move most with the target (``epoch_s, target``)."""
    scores = correlate(rates, target, method, min_abs)
    return top_k(scores, [F.abs("corr").desc(), F.col("series_id")], k)


def request_report(
    spark: SparkSession, path: str, q: float = 0.95, factor: int = 1_000, fmt: str = "triple"
) -> DataFrame:
    """Response-time quantile and throughput of a request log per tick."""
    requests = read_requests(spark, path, fmt)
    quantiles = response_percentiles_hdr(requests, q, factor).withColumnRenamed("value", "response_time")
    return quantiles.join(throughput(requests, factor), "tick", "full")
