"""Replay of one kind of result: the same rows, and no other work."""

import os

import pytest

from helpers import rows
from slowtrace.operators import multiplex
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import replay
from slowtrace.streaming.run import drain_batches

US = 1_000_000
SCHEMA = "kind string, ts long, seq long, poll_id long, pid long, tid long, fs_magic int, device_id int, inode_id long"
LOG = [
    (0.2, "epoll_insert", 7, None, 5), (0.5, "epoll_start", 7, 1, None), (1.4, "epoll_end", 7, 1, None),
    (2.0, "poll_start", None, 3, None), (2.1, "poll_register", None, 3, 8), (4.0, "epoll_start", 7, 1, None),
    (6.4, "poll_end", None, 3, None), (9.1, "epoll_end", 7, 1, None), (12.0, "epoll_start", 7, 9, None), (30.0, "epoll_start", 7, 4, None),
]


@pytest.mark.parametrize("result", [replay.THREADS, replay.FILES])
def test_only_what_is_asked_for(spark, tmp_path, result):
    src, path, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    data = [(k, int(s * US), i, p, 1, tid, 0, 0, f) for i, (s, k, p, tid, f) in enumerate(LOG)]
    for part in (data[:4], data[4:7], data[7:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        drain_batches(read_events_stream(spark, src, SCHEMA), replay.replay_batches(path, US, 2 * US, US, [result]), ck)
    events = spark.createDataFrame(data[:-1], SCHEMA)
    make = multiplex.muxio_wait if result == replay.THREADS else multiplex.muxio_file_wait
    want = make(events, US, 28 * US, US)
    assert rows(replay.replayed_waits(spark, path, result), *want.columns) == list(rows(want))
    assert {replay.THREADS, replay.FILES} & set(os.listdir(path)) == {result}
    with pytest.raises(ValueError, match="was carried for"):
        replay.replay_batches(path, US, 2 * US, US)(events, 3)
