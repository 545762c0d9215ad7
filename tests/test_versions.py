"""Versions and folds: repeated batches, readers between, two writers, failures half way."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from helpers import rows
from slowtrace.sources.versions import Conflict, Part, Version, Versions
from slowtrace.streaming.fold import BASE, STAGED, FoldedTable

SCHEMA = StructType([StructField("bucket", LongType()), StructField("file", StringType()), StructField("total_time", LongType()),
                     StructField("total_requests", LongType())])
LATE = "bucket long, file string, additional_time long"


@pytest.fixture
def table(spark, tmp_path):
    return FoldedTable(spark, f"file://{tmp_path}/table", SCHEMA, ["bucket", "file"], 10)


def add(table, batch, done=(), late=(), writer="w"):
    spark = table.spark
    return table.add(spark.createDataFrame([*done], SCHEMA), spark.createDataFrame([*late], LATE), writer, batch)


def test_batches_folds_and_readers_between(table):
    assert rows(table.read()) == []
    add(table, 0, [(3, "a", 5, 1), (12, "a", 1, 1)], [(2, "a", 10), (2, "a", 1), (3, "a", 10)])
    want = [(2, "a", 11, None), (3, "a", 15, 1), (12, "a", 1, 1)]
    assert rows(table.read()) == want
    add(table, 0, [(3, "a", 5, 1)], [(2, "a", 10)])  # the same batch again
    assert rows(table.read()) == want
    before = table.versions.read()
    after = table.fold()
    assert rows(table.read()) == want and not after.of(STAGED)
    # day 1 had nothing late and one part: it was not written again
    assert [p for p in before.of(BASE) if p.split == "1"] == [p for p in after.of(BASE) if p.split == "1"]
    assert rows(table.read(before.number)) == want
    add(table, 1, [(3, "b", 7, 2)], [(12, "a", 4), (3, None, 2), (-4, "a", 1)])
    want = [(2, "a", 11, None), (3, "a", 15, 1), (3, "b", 7, 2), (3, None, 2, None), (12, "a", 5, 1), (-4, "a", 1, None)]
    assert rows(table.read()) == want
    table.fold()
    assert rows(table.read()) == want and table.fold() == table.versions.read()


def test_parts_stay_bounded(table):
    for batch in range(6):
        add(table, batch, [(batch, "a", 1, 1)], [(0, "a", 1)])
        if batch % 2:
            table.fold()
            table.versions.forget(keep=1)
    version = table.versions.read()
    assert len(version.parts) == 1 and table.versions.numbers() == [version.number]
    assert rows(table.read()) == [(0, "a", 7, 1), *[(b, "a", 1, 1) for b in range(1, 6)]]


def test_add_during_a_fold_stays(table, monkeypatch):
    add(table, 0, [(1, "a", 1, 1)], [(1, "a", 5)])
    commit = Versions.commit

    def slow(self, change, writer=None, batch=None):
        if writer is None:
            monkeypatch.setattr(Versions, "commit", commit)
            add(table, 0, [(1, "a", 2, 1)], [(2, "b", 9)], writer="other")
        return commit(self, change, writer, batch)

    monkeypatch.setattr(Versions, "commit", slow)
    table.fold()
    assert rows(table.read()) == [(1, "a", 8, 2), (2, "b", 9, None)]


def test_two_folds_at_once_count_once(table, monkeypatch):
    add(table, 0, [(1, "a", 1, 1)], [(1, "a", 5)])
    commit = Versions.commit

    def slow(self, change, writer=None, batch=None):
        monkeypatch.setattr(Versions, "commit", commit)
        table.fold()
        return commit(self, change, writer, batch)

    monkeypatch.setattr(Versions, "commit", slow)
    table.fold()
    assert rows(table.read()) == [(1, "a", 6, 1)]


def test_failure_before_the_commit_leaves_nothing(table, monkeypatch):
    add(table, 0, [(1, "a", 1, 1)])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Versions, "_put", broken)
        with pytest.raises(OSError):
            add(table, 1, [(1, "a", 1, 1)], [(1, "a", 3)])
    assert rows(table.read()) == [(1, "a", 1, 1)]
    add(table, 1, [(1, "a", 1, 1)], [(1, "a", 3)])
    assert rows(table.read()) == [(1, "a", 5, 2)]


def test_a_version_is_written_once(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    one, other = Part(BASE, "0", "x"), Part(BASE, "0", "y")
    assert versions._put(Version(1, frozenset({one}), {}))
    assert not versions._put(Version(1, frozenset({other}), {}))
    assert versions.read().parts == {one}
    assert versions.commit(lambda now: ({other}, set())).number == 2
    with pytest.raises(Conflict):
        versions.commit(lambda now: (set(), {Part(BASE, "0", "z")}))
    assert versions.commit(lambda now: (set(), set()), "w", 3) == versions.commit(lambda now: ({one}, set()), "w", 3)
