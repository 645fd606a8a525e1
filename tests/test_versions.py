"""Versioned tables: append, upsert, replace, conflicts, failures, compaction."""
import pytest
from pyspark.sql import functions as F

from bidscope.operators import versions as V


def rows(spark, data):
    return spark.createDataFrame(data, "id string, at long, text string")


def newest(df):
    return V.newest_by("id", F.col("at"))(df)


def got(t):
    df = t.read()
    return [] if df is None else sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return V.Table(spark, str(tmp_path / "t"), "id", buckets=4)


def test_upsert_rewrites_only_touched_buckets(spark, table):
    assert table.read() is None and table.current()["version"] == 0
    table.append(rows(spark, [(f"k{i}", 1, "a") for i in range(40)]))
    before = table.current()["live"]
    assert len(before) == 4
    table.upsert(rows(spark, [("k3", 2, "new"), ("k3", 0, "old"), ("new", 1, "n")]), newest)
    after = table.current()["live"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert got(table) == sorted([(f"k{i}", 1, "a") for i in range(40) if i != 3] + [("k3", 2, "new"), ("new", 1, "n")])
    # an older version loses, a tie has one winner however the rows are dealt
    table.upsert(rows(spark, [("k3", 1, "late")]), newest)
    assert ("k3", 2, "new") in got(table)
    ties = [("tie", 5, x) for x in "abc"]
    assert len({tuple(newest(rows(spark, ties).repartition(n)).collect()[0]) for n in (1, 2, 3)}) == 1


def test_failed_and_empty_writes_leave_the_version(spark, table):
    table.append(rows(spark, [("a", 1, "x")]))
    v = table.current()["version"]
    broken = rows(spark, [("b", 1, "x")]).withColumn("text", F.expr("raise_error('no')").cast("string"))
    for write in (table.append, table.replace, lambda d: table.upsert(d, newest)):
        with pytest.raises(Exception):
            write(broken)
    none = rows(spark, []).where("id is null")
    table.append(none)
    table.upsert(none, newest)
    assert table.replace(none) is None
    assert table.current()["version"] == v and got(table) == [("a", 1, "x")]
    with pytest.raises(ValueError, match="column at"):
        table.append(spark.createDataFrame([("c", "text")], "id string, at string"))
    assert got(table) == [("a", 1, "x")]


def test_a_writer_that_comes_second_changes_the_new_version(spark, table, monkeypatch):
    table.append(rows(spark, [("a", 1, "x")]))
    publish, calls = V.Table._publish, []

    def late(self, state):
        if not calls:  # another writer is faster
            calls.append(1)
            other = V.Table(spark, table.path, "id")
            other.upsert(rows(spark, [("a", 3, "other"), ("b", 1, "other")]), newest)
        publish(self, state)
    monkeypatch.setattr(V.Table, "_publish", late)
    table.upsert(rows(spark, [("a", 2, "mine"), ("b", 2, "mine")]), newest)
    assert got(table) == [("a", 3, "other"), ("b", 2, "mine")]
    assert table.current()["version"] == 3


def test_stream_batches_count_once(spark, table):
    for _ in range(2):
        table.append(rows(spark, [("a", 1, "x")]), stream=("s", 0))
    table.append(rows(spark, [("b", 1, "x")]), stream=("s", 1))
    table.append(rows(spark, [("c", 1, "x")]), stream=("other", 0))
    table.upsert(rows(spark, [("d", 1, "x")]), newest, stream=("s", 1))
    assert [r[0] for r in got(table)] == ["a", "b", "c"]


def test_compact_vacuum_new_columns_totals(spark, table):
    count = lambda d: {"n": d.count(), "lists": [d.count(), 1]}
    for i in range(5):
        table.append(rows(spark, [(f"k{j}", i, "x") for j in range(12)]), totals=count)
    assert table.current()["totals"] == {"n": 60, "lists": [60, 5]}
    table.append(spark.createDataFrame([("wide", 1, "x", 2.5)], "id string, at long, text string, more double"), totals=count)
    want = sorted(map(str, got(table)))
    assert len(want) == 61 and max(len(c) for c in table.current()["live"].values()) >= 5
    table.compact(most=2)
    assert max(len(c) for c in table.current()["live"].values()) <= 2 and sorted(map(str, got(table))) == want
    assert table.current()["totals"]["n"] == 61
    state = table.current()
    assert table.vacuum(keep=1) and sorted(map(str, got(table))) == want
    table.replace(rows(spark, [("only", 1, "x")]))
    assert got(table) == [("only", 1, "x")] and sorted(map(str, table.read(state).collect())) != want
    table.clear()
    assert table.read() is None
