"""Every registered query against its SQL on the small tables."""

import datetime
import math
import os

import duckdb
import pytest
from fleetlens.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    other = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert len(rows) == len(other)
    key = lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r)
    exact = lambda r: tuple((x is None, str(x)) for x in r if not isinstance(x, float)) + key(r)
    for a, b in zip(sorted(rows, key=exact), sorted(other, key=exact), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)
