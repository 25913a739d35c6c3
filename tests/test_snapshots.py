"""Snapshot commits: merging, versions, repeated sources, two writers at once, and writers that are lost."""

import os
import threading

import pytest
from fleetlens.sources.snapshots import SnapshotTable
from pyspark.sql import functions as F


def rows(spark, items):
    return spark.createDataFrame(items, "file string, ord long, v long")


def held(table, version=None):
    return sorted((r.file, r.ord, r.v) for r in table.read(version).collect())


def test_latest_row_of_each_key(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "file", "ord", buckets=4)
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(rows(spark, [("a", 5, 1), ("b", 5, 1), ("b", 6, 2), (None, 1, 9)])) == 1
    assert table.upsert(rows(spark, [("a", 4, 7), ("b", 6, 8), ("c", 1, 9), (None, 2, 10)])) == 2
    assert sorted((r.file or "", r.ord, r.v) for r in table.read().collect()) == [("", 2, 10), ("a", 5, 1), ("b", 6, 8), ("c", 1, 9)]
    assert table.read(1).count() == 3  # an old version stays readable
    wide = rows(spark, [("d", 1, 1)]).withColumn("note", F.lit("x")).drop("v")
    table.upsert(wide)
    got = {r.file: (r.v, r.note) for r in table.read().collect()}
    assert got["d"] == (None, "x") and got["a"] == (1, None)
    with pytest.raises(ValueError):
        table.read(9)


def test_a_commit_rewrites_only_its_buckets(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "file", "ord", buckets=32)
    table.upsert(spark.range(500).select(F.col("id").cast("string").alias("file"), F.lit(1).cast("long").alias("ord"), F.col("id").alias("v")))
    before = table._load(1)["buckets"]
    table.upsert(rows(spark, [("7", 2, -7)]))
    after = table._load(2)["buckets"]
    assert len(before) == 32 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 500
    assert table.read().filter("v = -7").count() == 1


def test_numbers_of_a_source_count_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "file", "ord")
    assert [table.upsert(rows(spark, [("a", n, n)]), ("s", n)) for n in (0, 1, 1, 0)] == [1, 2, 2, 2]
    assert table.upsert(rows(spark, []), ("s", 2)) == 3 and table.upsert(rows(spark, [("b", 1, 1)]), ("other", 0)) == 4
    assert held(table) == [("a", 1, 1), ("b", 1, 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(name):
        try:
            for n in range(4):
                SnapshotTable(spark, path, "file", "ord", buckets=2).upsert(rows(spark, [(f"{name}{n}", n, n), ("both", n, ord(name))]), (name, n))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    table = SnapshotTable(spark, path, "file", "ord", buckets=2)
    assert not failed and table.versions() == list(range(1, 9))
    assert {f for f, *_ in held(table)} == {"both", *(f"{n}{i}" for n in "xy" for i in range(4))}


def test_lost_writers_leave_no_trace(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = SnapshotTable(spark, path, "file", "ord")
    table.upsert(rows(spark, [("a", 1, 1)]))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_put", lost)
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, [("a", 2, 2)]))
    monkeypatch.undo()
    assert held(table) == [("a", 1, 1)] and len(os.listdir(f"{path}/data")) == 2
    table.upsert(rows(spark, [("b", 1, 1)]))
    table.vacuum()
    assert held(table) == [("a", 1, 1), ("b", 1, 1)] and table.versions() == [2]
    assert len(os.listdir(f"{path}/data")) == len({p.split("/")[1] for p in table._load(2)["buckets"].values()})
