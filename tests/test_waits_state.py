"""The wait machine over states in memory: one look at the buffer per batch, and waits like in a plain loop."""

import random
from collections import Counter

import pandas as pd

from slowtrace.streaming.waits import WaitMachine

B = 1_000_000


class State:
    def __init__(self):
        self.held, self.reads = [], 0

    def exists(self):
        return bool(self.held)

    def appendValue(self, row):
        self.held.append(row)

    def put(self, rows):
        self.held = list(rows)

    def update(self, row):
        self.held = [row]

    def clear(self):
        self.held = []

    def get(self):
        self.reads += 1
        return self.held[0]


class Rows(State):
    def get(self):
        self.reads += 1
        return iter(self.held)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, _):
        return self.states.setdefault(name, Rows())

    def getValueState(self, name, _):
        return self.states.setdefault(name, State())

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, watermark_us):
        self.ms = watermark_us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def advance(machine, handle, events, watermark):
    """One micro-batch: its rows, then every timer that is due."""
    columns = ["ts", "seq", "kind", "thread", "file"]
    if events:
        list(machine.handleInputRows(("7",), iter([pd.DataFrame(events, columns=columns)]), Clock(watermark)))
    out = []
    for timer in sorted(t for t in handle.timers if t <= watermark // 1000):
        handle.timers.discard(timer)
        for frame in machine.handleExpiredTimer(("7",), Clock(watermark), timer):
            out += [tuple(r) for r in frame[["bucket", "what", "name", "total_time", "total_requests"]].itertuples(index=False)]
    return out


def plain(log, closed):
    """The same rules event by event and bucket by bucket."""
    time, count, threads, files, session = Counter(), Counter(), {}, {}, None
    log = sorted(e for e in log if e[0] < closed)

    def add(what, name, since, until):
        while since < until:
            end = min(until, (since // B + 1) * B)
            time[since // B * B, what, name] += end - since
            since = end

    for ts, _, kind, thread, file in log:
        before = bool(threads)
        if kind == "epoll_start":
            if thread in threads:
                add("thread", thread, threads[thread], ts // B * B)
            threads[thread] = ts
            session = session if before else ts
        elif kind in ("epoll_end", "thread_exit") and thread in threads:
            add("thread", thread, threads.pop(thread), ts)
            count[ts // B * B, "thread", thread] += kind == "epoll_end"
            if not threads:
                for f, since in files.items():
                    add("file", f, max(since, session), ts)
                    count[ts // B * B, "file", f] += kind == "epoll_end"
                session = None
        elif kind == "set_closed":
            for t, since in threads.items():
                add("thread", t, since, ts)
            for f, since in files.items():
                if before:
                    add("file", f, max(since, session), ts)
            threads, files, session = {}, {}, None
        elif kind == "epoll_insert":
            files.setdefault(file, ts)
        elif kind == "epoll_remove" and threads and file in files:
            add("file", file, max(files.pop(file), session), ts)
            count[ts // B * B, "file", file] += 1
    for t, since in threads.items():
        add("thread", t, since, closed)
    for f, since in files.items():
        if threads:
            add("file", f, max(since, session), closed)
    return sorted((*k, time[k], count[k]) for k in {*time, *count} if time[k] or count[k])


def test_one_look_at_the_buffer_per_batch():
    handle, machine = Handle(), WaitMachine(B)
    machine.init(handle)
    log = [(i * B + 5, i, "epoll_start" if i % 2 else "epoll_end", "t", None) for i in range(300)]
    advance(machine, handle, log, 0)
    assert len(advance(machine, handle, [], 300 * B)) == 300 - 1
    assert handle.states["buffer"].reads == 1


def test_equals_a_plain_loop():
    rng = random.Random(5)
    kinds = ["epoll_start", "epoll_end", "epoll_insert", "epoll_remove"] * 6 + ["thread_exit"] * 3 + ["set_closed"]
    for trial in range(60):
        n, gap = 150, rng.choice([40_000, 300_000, 2_500_000])
        times = sorted(rng.randrange(n * gap) // 1000 * 1000 for _ in range(n))
        log = [(t, i, rng.choice(kinds), rng.choice("abc"), rng.choice("xyz")) for i, t in enumerate(times)]
        handle, machine, got = Handle(), WaitMachine(B), []
        machine.init(handle)
        for part in range(5):
            batch = log[part * n // 5:(part + 1) * n // 5]
            got += advance(machine, handle, rng.sample(batch, len(batch)), max(0, (log[part * n // 5 - 1][0] if part else 0)))
        end = log[-1][0] + 3 * B
        got += advance(machine, handle, [], end)
        assert sorted(got) == plain(log, end // B * B), trial
