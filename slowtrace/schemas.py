"""Explicit schemas. Jobs never infer one.

Kernel addresses exceed 2^63, so they are decimals; nanosecond totals fit a long.
"""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = T.DecimalType(20, 0)
HIST = [f"hist{i}" for i in range(8)]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _S, _B, _D, _TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType(),
    T.TimestampNTZType(),
)
_HIST = [(h, _L) for h in HIST]

TASKSTATS = _struct(
    ("ts", _TS), ("pid", _L), ("tid", _L), ("comm", _S), ("nvcsw", _L), ("nivcsw", _L),
    ("run_time_total", _L), ("rq_time_total", _L), ("rq_count", _L),
    ("blkio_time_total", _L), ("blkio_count", _L), ("uninterruptible_total", _L),
    ("freepages_time_total", _L), ("freepages_count", _L),
    ("thrashing_time_total", _L), ("thrashing_count", _L),
    ("swapin_time_total", _L), ("swapin_count", _L),
)

IOWAIT = _struct(
    ("ts_s", _TS), ("pid", _L), ("tid", _L), ("part0", _L), ("bdev", _L),
    ("total_time", _L), ("sector_cnt", _L), ("total_requests", _L), *_HIST,
)

VFS_KEYS = ["ts_s", "pid", "tid", "fs_magic", "device_id", "inode_id", "op"]
VFS = _struct(
    ("ts_s", _TS), ("pid", _L), ("tid", _L), ("fs_magic", _L), ("device_id", _L),
    ("inode_id", ADDRESS), ("op", _I), ("total_time", _L), ("total_requests", _L), *_HIST,
)
VFS_STAGING = _struct(
    ("ts_s", _TS), ("pid", _L), ("tid", _L), ("fs_magic", _L), ("device_id", _L),
    ("inode_id", ADDRESS), ("op", _I), ("additional_time", _L),
)

FUTEX_KEYS = ["ts_s", "pid", "tid", "futex_key_addr", "futex_key_word", "futex_key_offset"]
_FUTEX = [
    ("ts_s", _TS), ("pid", _L), ("tid", _L), ("futex_key_addr", ADDRESS),
    ("futex_key_word", ADDRESS), ("futex_key_offset", _L),
]
FUTEX_WAIT = _struct(*_FUTEX, ("total_requests", _L), ("total_time", _L), *_HIST)
FUTEX_WAIT_STAGING = _struct(*_FUTEX, ("additional_time", _L))
FUTEX_WAKE = _struct(*_FUTEX, ("total_requests", _L), ("successful_count", _L))

MUXIO_WAIT = _struct(
    ("ts_s", _TS), ("pid", _L), ("tid", _L), ("is_epoll", _B), ("poll_id", ADDRESS),
    ("total_time", _L), ("total_requests", _L),
)
MUXIO_FILE_WAIT = _struct(
    ("ts_s", _TS), ("is_epoll", _B), ("poll_id", ADDRESS), ("fs_magic", _L),
    ("device_id", _L), ("inode_id", ADDRESS), ("total_time", _L), ("count", _L),
)

SOCKET_CONTEXT = _struct(("inode_id", ADDRESS), ("family", _I), ("type", _I), ("protocol", _I))
SOCKET_INET = _struct(
    ("inode_id", ADDRESS), ("netns_cookie", ADDRESS), ("src_address", _S), ("src_port", _I),
    ("dst_address", _S), ("dst_port", _I),
)
SOCKET_MAP = _struct(("sock1_inode_id", ADDRESS), ("sock2_inode_id", ADDRESS))
LINUX_CONSTS = _struct(("const_type", _S), ("const_name", _S), ("value", _L))

#: Every table of the store, by name. ``taskstats_view`` is derived on top of them.
TABLES: dict[str, T.StructType] = {
    "taskstats": TASKSTATS,
    "iowait": IOWAIT,
    "vfs": VFS,
    "vfs_staging": VFS_STAGING,
    "futex_wait": FUTEX_WAIT,
    "futex_wait_staging": FUTEX_WAIT_STAGING,
    "futex_wake": FUTEX_WAKE,
    "muxio_wait": MUXIO_WAIT,
    "muxio_file_wait": MUXIO_FILE_WAIT,
    "socket_context": SOCKET_CONTEXT,
    "socket_inet": SOCKET_INET,
    "socket_map": SOCKET_MAP,
    "linux_consts": LINUX_CONSTS,
}

#: Merge keys of the tables whose slices arrive late.
MERGE_KEYS = {"vfs": VFS_KEYS, "futex_wait": FUTEX_KEYS}

#: The long model of all metric series: one row per sample, never one column per series.
METRIC_POINTS = _struct(
    ("run_id", _S), ("scope", _S), ("pid", _L), ("tid", _L), ("comm", _S),
    ("metric_class", _S), ("ipc_type", _S), ("resource", _S), ("metric", _S),
    ("part_seq", _L), ("epoch_s", _L), ("epoch_ms", _L), ("value", _D),
)

REQUESTS = _struct(("start", _L), ("end", _L), ("duration", _L))

#: Raw poll/epoll events; ``kind`` is one of the seven names in operators.multiplex.
MUXIO_EVENT = _struct(
    ("kind", _S), ("ts", _L), ("seq", _L), ("poll_id", ADDRESS), ("pid", _L), ("tid", _L),
    ("fs_magic", _L), ("device_id", _L), ("inode_id", ADDRESS),
)

#: Raw start/end events of block IO, file, socket and futex calls.
CALL_EVENT = _struct(
    ("kind", _S), ("ts", _L), ("seq", _L), ("pid", _L), ("tid", _L), ("resource", _S),
    ("op", _I), ("size", _L), ("ret", _L),
)
