"""Interval and as-of joins against brute force: hot keys over several partitions, long windows, ties, nulls and empty tables."""

import random
from bisect import bisect_left, bisect_right

import pytest
from fleetlens.operators import joins
from fleetlens.operators.merging import running
from pyspark.sql import functions as F


def spread(n, hot):
    random.seed(n)
    return [(i, None if i % 97 == 0 else random.choice([7, 7, 7, hot, i % 5]), None if i % 89 == 0 else random.randrange(-2000, 2000)) for i in range(n)]


def test_running_values_cross_partitions(spark):
    rows = [(k, i, i if i % 50 == 0 and k == 1 else None, (i * 7919) % 400) for k in (1, 2) for i in range(400)]
    got = running(spark.createDataFrame(rows, "k int, at int, v int, w int"), ("k",), ("at",), last=("v",), following=("v",), most=("w",)).collect()
    assert len(got) == 800
    for r in got:
        assert r.last_v == (r.at // 50 * 50 if r.k == 1 else None)
        assert r.next_v == (-(-r.at // 50) * 50 if r.k == 1 and r.at <= 350 else None)
        assert r.most_w == max((i * 7919) % 400 for i in range(r.at + 1))


@pytest.mark.parametrize("by", [("k",), ()])
def test_nearest_in_time(spark, by):
    left = spark.createDataFrame(spread(1500, 3), "id int, k int, t long")
    right = [(k, t, float(i % 7) if i % 11 else None) for i, k, t in spread(900, 4) if not (t and 300 < t < 900)]
    got = {r.id: (r.near_t, r.near_value) for r in joins.nearest_in_time(left, spark.createDataFrame(right, "k int, rt long, v double"), 8, "v", by=by).collect()}
    least = lambda v: (v is not None, v)
    for i, k, t in spread(1500, 3):
        near = [] if t is None or (by and k is None) else [(abs(t - rt), rt, least(v)) for rk, rt, v in right if rt is not None and (not by or rk == k) and abs(t - rt) <= 8]
        want = min(near, default=(0, None, (0, None)))
        assert got[i] == (want[1], want[2][1]), (i, k, t)
    assert len(got) == 1500


def test_a_busy_second(spark):
    """10 ** 5 samples on each side within one tolerance: linear where pairs would be 10 ** 10."""
    n = 100_000
    left = spark.range(n).select("id", F.lit(1).alias("k"), (F.col("id") * 7 % n).alias("t"))
    right = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("rt"), F.col("id").alias("v"))
    near = joins.nearest_in_time(left, right, 10 * n, "v", by=("k",))
    assert near.filter((F.col("near_t") != F.col("t") - F.col("t") % 2) | F.col("near_t").isNull()).count() == 0 and near.count() == n


def windows_of(n):
    random.seed(n)
    out = []
    for i in range(n):
        lo = random.randrange(-2000, 2000)
        hi = lo + random.choice([0, 1, 2, 3, 5, 8, 31, 32, 33, 100, 700, 4000, -5])
        out.append((i, random.choice([7, 7, 3, None]), None if i % 31 == 0 else lo, None if i % 37 == 0 else hi))
    return out


@pytest.mark.parametrize("by", [("k",), ()])
def test_points_in_windows(spark, by):
    samples, windows = spread(700, 3), windows_of(120)
    s = spark.createDataFrame(samples, "id int, k int, t long")
    w = spark.createDataFrame(windows, "w int, k int, t0 long, t1 long")
    if not by:
        w = w.withColumnRenamed("k", "wk")
    inside = lambda k, t, row, lead=0, lag=0: None not in (t, row[2], row[3]) and row[2] - lead <= t <= row[3] + lag and (not by or (k is not None and row[1] == k))
    got = sorted((r.id, r.w) for r in joins.samples_in_windows(s, w, by=by).collect())
    assert got == sorted((i, row[0]) for i, k, t in samples for row in windows if inside(k, t, row))
    some = [row for row in windows if row[3] is None or row[2] is None or row[3] - row[2] < 60]
    out = joins.outside_all_windows(s, spark.createDataFrame(some, "w int, k int, t0 long, t1 long").withColumnRenamed("k", "k" if by else "wk"), 3, 9, by=by)
    assert out.columns == s.columns
    assert sorted(r.id for r in out.collect()) == [i for i, k, t in samples if not any(inside(k, t, row, 3, 9) for row in some)]


@pytest.mark.parametrize("by", [("k",), ()])
def test_overlapping_pairs(spark, by):
    a, b = windows_of(150), windows_of(149)
    left = spark.createDataFrame(a, "a int, k int, a0 long, a1 long")
    right = spark.createDataFrame(b, "b int, k int, b0 long, b1 long")
    if not by:
        right = right.drop("k")
    got = sorted((r.a, r.b) for r in joins.overlapping(left, right, ("a0", "a1"), ("b0", "b1"), by).collect())
    whole = lambda r: None not in (r[2], r[3]) and r[2] <= r[3]
    want = [(x[0], y[0]) for x in a for y in b if whole(x) and whole(y) and x[2] < y[3] and y[2] < x[3] and (not by or (x[1] is not None and x[1] == y[1]))]
    assert got == sorted(want)


def test_long_windows_stay_few_rows(spark):
    """A window of any length is a few cells: one of 2 ** 50 microseconds beside ones of a millisecond."""
    windows = spark.createDataFrame([(0, 0, 1 << 50), *((i, i << 20, (i << 20) + 1000) for i in range(1, 2000))], "w long, t0 long, t1 long")
    dealt = windows.withColumn("_level", joins._level("t0", "t1"))
    cells = dealt.select((joins._cell("t1", "_level") - joins._cell("t0", "_level") + 1).alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 10
    t = sorted((i * 7_654_321) % (1 << 31) for i in range(3000))
    got = joins.samples_in_windows(spark.createDataFrame([(x,) for x in t], "t long"), windows).groupBy("w").count().collect()
    want = {i: bisect_right(t, hi) - bisect_left(t, lo) for i, lo, hi in [(0, 0, 1 << 50), *((i, i << 20, (i << 20) + 1000) for i in range(1, 2000))]}
    assert {r.w: r["count"] for r in got} == {i: n for i, n in want.items() if n}


def test_fractions_and_empty_tables(spark):
    s = spark.createDataFrame([(i, i / 8) for i in range(80)], "id int, t double")
    w = spark.createDataFrame([(0, 0.1, 0.3), (1, 2.0, 2.0), (2, 1.0, 9.5)], "w int, t0 double, t1 double")
    got = sorted((r.id, r.w) for r in joins.samples_in_windows(s, w).collect())
    assert got == sorted((i, k) for i in range(80) for k, lo, hi in [(0, 0.1, 0.3), (1, 2.0, 2.0), (2, 1.0, 9.5)] if lo <= i / 8 <= hi)
    assert joins.samples_in_windows(s, w.limit(0)).count() == joins.samples_in_windows(s.limit(0), w).count() == 0
    assert joins.outside_all_windows(s, w.limit(0), 1, 1).count() == 80 and joins.outside_all_windows(s.limit(0), w, 1, 1).count() == 0
    r = spark.createDataFrame([], "rt double, v int")
    assert [x.near_t for x in joins.nearest_in_time(s, r, 5, "v").collect()] == [None] * 80
    assert joins.nearest_in_time(s.limit(0), r, 5, "v").count() == 0
