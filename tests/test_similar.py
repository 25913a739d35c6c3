"""Thinning, nearness and strata against sequential loops."""

import math
import random

import numpy as np
import pytest
from fleetlens.operators import similar


@pytest.mark.parametrize("pivots", [1, 8, 512])
def test_thinning_equals_the_walk_in_order(spark, pivots):
    """Each radius alone, whatever is settled in passes and whatever over edges; ties of priority go by key."""
    rng = random.Random(2)
    pts = [(i, [rng.random(), rng.random(), rng.random()], rng.randrange(20)) for i in range(150)]
    pts += [(200 + i, pts[i][1], 3) for i in range(5)]  # equal places
    df = spark.createDataFrame([*pts, (900, None, 50)], "id long, v array<double>, w int")
    radii = (0.0, 0.05, 0.25, 0.6, 5.0)
    x = {i: np.array(v) for i, v, _ in pts}
    want = set()
    for r in radii:
        kept = []
        for i, _, _ in sorted(pts, key=lambda p: (-p[2], p[0])):
            if all(np.linalg.norm(x[i] - x[k]) > r for k in kept):
                kept.append(i)
        want |= {(r, i) for i in kept}
    rows = similar.radius_thin(df, "id", "v", "w", radii, pivots=pivots)
    assert rows.columns == ["radius", "id", "v", "w"]
    assert {(r.radius, r.id) for r in rows.collect()} == want


def test_thinning_nothing_and_one(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 1)], "id long, v array<double>, w int")
    assert [(r.radius, r.id) for r in similar.radius_thin(df, "id", "v", "w", (0.1, 2.0)).orderBy("radius").collect()] == [(0.1, 1), (2.0, 1)]
    assert similar.radius_thin(df.limit(0), "id", "v", "w", (0.1, 2.0)).count() == 0


def test_thinning_broadcasts_no_edges_and_pairs_no_copies(spark, monkeypatch):
    """Edges, however few bytes their files have, are merged in parts that grow in number with their rows; equal vectors never meet."""
    plans, met = [], []
    write, pairs = similar.written, similar.pair_within

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    def seen(vectors, *a, **k):
        met.append(vectors.select("v").collect())
        return pairs(vectors, *a, **k)

    monkeypatch.setattr(similar, "written", watched)
    monkeypatch.setattr(similar, "pair_within", seen)
    monkeypatch.setattr(similar, "_ROWS_A_TASK", 2)
    rng = random.Random(3)
    pts = [(i, [rng.random(), rng.random()], rng.randrange(5)) for i in range(40)]
    pts += [(100 + i, pts[i % 6][1], rng.choice([None, 1, 4, 9])) for i in range(12)]
    df = spark.createDataFrame(pts, "id long, v array<double>, w int")
    got = {(r.radius, r.id) for r in similar.radius_thin(df, "id", "v", "w", (0.05,), pivots=1).collect()}
    for r in (0.05,):
        kept = []
        for i, v, _ in sorted(pts, key=lambda p: (p[2] is None, -(p[2] or 0), p[0])):
            if all(math.dist(v, k) > r for _, k in kept):
                kept.append((i, v))
        assert {i for at, i in got if at == r} == {i for i, _ in kept}
    joins = [p for name, p in plans if name.startswith("thin-") and "Join" in p and "meet(" not in p]  # pair_within broadcasts the sizes of its cells
    assert joins and not [p for p in joins if "Broadcast" in p]
    assert "REPARTITION_BY_NUM" in "".join(joins)
    assert len(met[0]) == len({tuple(r.v) for r in met[0]}) <= 40


def test_distance_to_nearest(spark):
    rng = random.Random(4)
    place = lambda wide: (rng.uniform(-wide, wide), rng.uniform(-wide, wide))
    points = [(i, rng.randrange(3), *place(60)) for i in range(400)] + [(500, 0, None, 1.0), (501, 7, 0.0, 0.0), (502, 1, 30.0, 30.0)]
    sources = [(rng.randrange(3), *(place(60) if rng.random() < 0.3 else place(5))) for _ in range(120)] + [(1, 30.0, 30.0)] * 3 + [(1, None, 2.0)]
    p = spark.createDataFrame(points, "id int, image int, x double, y double")
    s = spark.createDataFrame(sources, "image int, x double, y double")
    for most in (2.0, 17.0, 300.0):
        got = {r.id: r.distance for r in similar.distance_to_nearest(p, s, most, "image", "id").collect()}
        assert len(got) == len(points)
        for i, image, x, y in points:
            near = [math.hypot(x - a, y - b) for k, a, b in sources if k == image and a is not None] if x is not None else []
            want = min(near, default=most)
            assert (got[i] is None) if want >= most else math.isclose(got[i], want, abs_tol=1e-12), (i, most)


@pytest.mark.parametrize("few", [0, 3])
def test_distance_to_nearest_in_crowded_tiles(spark, few):
    """Tiles with more than ``few`` sources go by cells: together with the others each point has its distance once, negative places too."""
    rng = random.Random(6)
    place = lambda wide: (rng.uniform(-wide, wide), rng.uniform(-wide, wide))
    points = [(i, rng.randrange(2), *place(60)) for i in range(300)] + [(500, 0, None, 1.0), (501, 7, 0.0, 0.0), (502, None, 1.0, 1.0)]
    sources = [(rng.randrange(2), *(place(60) if rng.random() < 0.3 else place(5))) for _ in range(150)]
    p = spark.createDataFrame(points, "id int, image int, x double, y double")
    s = spark.createDataFrame(sources, "image int, x double, y double")
    for most in (2.0, 17.0):
        rows = similar.distance_to_nearest(p, s, most, "image", "id", few=few).collect()
        assert sorted(r.id for r in rows) == [r[0] for r in points]
        for r in rows:
            want = min((math.hypot(r.x - a, r.y - b) for k, a, b in sources if k == r.image), default=most) if r.x is not None else most
            assert (r.distance is None) if want >= most else math.isclose(r.distance, want, abs_tol=1e-12), (r, most)


def test_distance_to_nearest_explodes_sources_alone(spark):
    """Only sources are sent to tiles around them; points stay one row each."""
    p = spark.range(200).selectExpr("id", "id % 4 as image", "cast(id * 7 % 499 as double) as x", "cast(id * 13 % 251 as double) as y")
    out = similar.distance_to_nearest(p, p.filter("id % 3 = 0"), 25.0, "image", "id")
    sent = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(sent) == 2 and all("sx" in line or "sy" in line for line in sent)


def test_mid_strata(spark):
    rows = [(k, i) for k in (1, 2, 3, 7, 24, 25, 26, 60, 1000) for i in range(k)]
    got = sorted((r.k, r.i) for r in similar.mid_stratum_sample(spark.createDataFrame(rows, "k int, i long"), "k", "i", 25).collect())
    want = sorted((k, math.floor((i + 0.5) * k / min(25, k))) for k in (1, 2, 3, 7, 24, 25, 26, 60, 1000) for i in range(min(25, k)))
    assert got == want
