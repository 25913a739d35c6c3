"""The tile source: what it reads, what it refuses, and what its filters keep from being planned and read."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from fleetlens.sources.tiles import TileReader, TileSource
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains


@pytest.fixture
def directory(tmp_path):
    rows, at = [], 0
    with open(tmp_path / "a.bin", "wb") as f:
        for i in range(40):
            data = zlib.compress(bytes([i]) * (i + 1)) if i != 7 else b"no deflate"
            f.write(data)
            rows.append({"path": f"file://{tmp_path}/a.bin", "idx": i, "offset": at, "length": len(data), "codec": 5 if i % 10 == 3 else 8 if i % 2 else 32946})
            at += len(data)
    rows.append({"path": f"file://{tmp_path}/gone.bin", "idx": 90, "offset": 0, "length": 3, "codec": 8})
    rows.append({"path": None, "idx": 91, "offset": None, "length": 3, "codec": 8})
    (tmp_path / "dir").mkdir()
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("path", pa.string()), ("idx", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("codec", pa.int32())])), tmp_path / "dir" / "d.parquet", row_group_size=10)
    return f"file://{tmp_path}/dir"


def test_tiles_and_refusals(spark, directory):
    spark.dataSource.register(TileSource)
    got = {r.idx: (r.px, r.reason) for r in spark.read.format("tiles").option("directory", directory).load().collect()}
    assert len(got) == 42
    for i in range(40):
        if i % 10 == 3:
            assert got[i] == (None, "codec 5")
        else:
            assert got[i] == ((None, "error") if i == 7 else (bytes([i]) * (i + 1), None))
    assert got[90] == (None, "FileNotFoundError") and got[91][0] is None and got[91][1]


def test_filters_reach_the_source(spark, directory, capsys):
    spark.dataSource.register(TileSource)
    source = spark.read.format("tiles").option("directory", directory)
    tiles = source.load().filter("codec = 8 and idx > 12 and idx <= 25 and px is not null")
    assert sorted(r.idx for r in tiles.collect()) == [15, 17, 19, 21, 25]
    tiles.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(codec,8)" in plan.replace(" ", "") and "LessThanOrEqual(idx,25)" in plan.replace(" ", "")
    assert source.load().filter("idx > 1000").count() == 0


def test_row_groups_that_filters_exclude_are_not_planned(directory):
    reader = TileReader(directory)
    left = list(reader.pushFilters([GreaterThan(("idx",), 12), In(("codec",), (8, 5)), StringContains(("path",), "a"), EqualTo(("idx",), None)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    assert [p.number for p in reader.partitions()] == [1, 2, 3, 4]
    reader.pushFilters([])
    one = TileReader(directory)
    list(one.pushFilters([EqualTo(("idx",), 25)]))
    assert [p.number for p in one.partitions()] == [2]
    assert [b.to_pylist()[0]["idx"] for p in one.partitions() for b in one.read(p)] == [25]
