"""Exact quantiles from bracketed ranks against numpy."""

import math
import random

import numpy as np
import pytest
from fleetlens.operators.fleet import compare_runs
from fleetlens.operators.stats import quantiles, whole_ranks
from pyspark.sql import functions as F


def test_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [("many", rng.gauss(0, 9), None) for _ in range(6000)] + [("ties", float(rng.choice([1, 1, 1, 2, 3])), 5.0) for _ in range(3000)]
    rows += [("few", float(i), -float(i)) for i in range(3)] + [("one", 4.0, 4.0), ("none", None, None), (None, 1.5, 2.5), (None, 2.5, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(4)
    wanted = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("w", 0.25), "d": ("v", 0.0), "e": ("v", 1.0), "f": ("v", 0.001)}
    got = {r.k: r for r in quantiles(df, ["k"], wanted, accuracy=50).collect()}
    assert "none" not in got
    for key in ("many", "ties", "few", "one", None):
        for name, (column, q) in wanted.items():
            x = [r[1 if column == "v" else 2] for r in rows if r[0] == key]
            x = [v for v in x if v is not None]
            assert (got[key][name] is None) if not x else math.isclose(got[key][name], float(np.quantile(x, q)), abs_tol=1e-12), (key, name)
    assert quantiles(df.limit(0), ["k"], wanted).count() == 0


def test_only_the_bracket_is_ranked(spark):
    """Of 200,000 different values a few hundredths are shuffled by value."""
    df = spark.range(200_000).selectExpr("1 as k", "cast(id * 7919 % 200000 as double) as v")
    assert [tuple(r) for r in quantiles(df, ["k"], {"m": ("v", 0.5)}).collect()] == [(1, 99_999.5)]


@pytest.mark.parametrize("n", [1, 10, 70, 5000])
def test_whole_ranks_equal_a_sorted_list(spark, n):
    rng = random.Random(n)
    x = [float(rng.choice([rng.gauss(0, 9), 1, 1, 2])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "ms double").repartition(4)
    wanted = {"a": 0.0, "b": 0.1, "c": 0.102, "d": 0.5, "e": 0.9, "f": 1.0}
    upper, nearest = (whole_ranks(df, "ms", wanted, rule, accuracy=50).first() for rule in ("upper", "nearest"))
    for name, q in wanted.items():
        assert upper[name] == sorted(x)[min(math.floor(n * q), n - 1)] and nearest[name] == sorted(x)[max(math.ceil(n * q) - 1, 0)], (name, n)
    assert whole_ranks(df.limit(0), "ms", wanted, "upper").first() == (None,) * len(wanted)


def test_compared_runs_do_not_multiply_partitions(spark):
    """Joins of single rows: the number of partitions is not a product of those of the runs."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        runs = [spark.range(900).select((F.col("id") * 7 % 900 * k).cast("double").alias("ms")) for k in (1, 2)]
        both = compare_runs(*runs, 8)
        assert both.rdd.getNumPartitions() == 1
        assert [(r.n_a, r.p10_a, r.p90_a, r.p10_b, r.p90_b, r.warn) for r in both.collect()] == [(900, 90.0, 810.0, 180.0, 1620.0, "over 10 %")]
        assert compare_runs(runs[0], runs[1].limit(0), 8).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
