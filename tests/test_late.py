"""Late rows: reported with their bucket, and together with the sums they are the input."""

import random

from pyspark.sql import functions as F

from helpers import rows
from slowtrace.sources.events import read_events_stream
from slowtrace.streaming import late
from slowtrace.streaming.run import drain_stateful

US = 1_000_000
BASE = 1_735_689_600 * US
SCHEMA = "sec double, k string, v long"


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, src, out, ck, salts=3):
    stream = read_events_stream(spark, src, SCHEMA).withColumn("ts", F.timestamp_micros((F.lit(BASE) + F.col("sec") * US).cast("bigint")))
    values = {"n": F.lit(1), "total": F.col("v")}
    sums = late.sums_and_late_rows(stream, ["k"], values, US, "2 seconds", payload=["sec", "v"], salts=salts)
    drain_stateful(sums, late.late_batches(out, ["k"], [*values]), ck)
    second = ((F.col("bucket") - BASE) / US).cast("int")
    return (rows(late.closed_sums(spark, out).select(second, "k", "n", "total")),
            rows(late.late_rows(spark, out).select(second, "k", "n", "total", "payload")))


def test_late_rows_come_with_their_bucket(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [(0.1, "a", 5), (0.9, "a", 2), (1.5, None, None), (5.0, "b", 1), (None, "a", 1)])
    kept, behind = run(spark, src, out, ck)
    assert kept == [(0, "a", 2, 7), (1, None, 1, 0), ] and behind == []
    # the watermark is at 3 s: second 0 and 2 are closed, second 4 is not
    put(spark, src, [(0.5, "a", 99), (2.5, "c", None), (4.2, "a", 7), (20.0, "a", 1)])
    kept, behind = run(spark, src, out, ck)
    assert behind == [(0, "a", 1, 99, '{"sec":0.5,"v":99}'), (2, "c", 1, 0, '{"sec":2.5,"v":null}')]
    assert kept == [(0, "a", 2, 7), (1, None, 1, 0), (4, "a", 1, 7), (5, "b", 1, 1)]


def test_kept_and_late_are_the_input(spark, tmp_path):
    """One key has most rows; they are spread over several states and still one row per bucket."""
    rng = random.Random(2)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    data = [(rng.random() * 30, rng.choice("aaaaab"), rng.randrange(50)) for _ in range(600)]
    arrival = sorted(data, key=lambda r: r[0] + rng.random() * 8)
    for part in range(4):
        put(spark, src, arrival[part * 150:(part + 1) * 150])
        kept, behind = run(spark, src, out, ck)
    assert len({r[:2] for r in kept}) == len(kept) and behind
    closed = int(max(r[0] for r in data) - 2)
    want = {}
    for second, k, v in data:
        if int(second) < closed:
            n, total = want.get((int(second), k), (0, 0))
            want[int(second), k] = n + 1, total + v
    got = {}
    for second, k, n, total, *_ in [*kept, *behind]:
        a, b = got.get((second, k), (0, 0))
        got[second, k] = a + n, b + total
    assert got == want
