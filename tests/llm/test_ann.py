"""Nearest neighbours: recall against brute force, exact scores, order and edge cases."""

import os

import numpy as np
import pandas as pd
import pytest
from fleetlens.llm.ann import Rotations, _axes_of, _best_probes, nearest, plan_of
from fleetlens.llm.queries import op1_nearest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def brute(rows, asked, k):
    out = {}
    for q, a in asked:
        s = []
        for i, v in rows:
            if i != q and len(v) == len(a):
                t = 0.0
                for x, y in zip(a, v, strict=True):
                    t += float(x) * float(y)
                s.append((-t, i))
        out[q] = [(i, -t) for t, i in sorted(set(s))[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    for scale in (1, 3):
        x = rng.normal(size=(1500, 32))
        x /= np.linalg.norm(x, axis=1)[:, None] * (1 if scale == 1 else rng.uniform(0.3, 1, (1500, 1)))
        x = x.astype(np.float32)
        x[100:160] = x[0]  # many equal vectors
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
        df = spark.createDataFrame([(*r, r[0], 1.0) for r in rows], "vec_id long, embedding array<float>, q long, score double")
        got = {}
        for r in nearest(df, df.filter("vec_id % 20 == 0"), k=10, block=300).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        asked = rows[::20]
        want = brute(rows, asked, 10)
        hits = 0
        for q, w in want.items():
            mine = [got[q][r] for r in range(1, 11)]
            exact = dict(brute(rows, [(q, rows[q][1])], 10_000)[q])
            assert all(exact[i] == s for i, s in mine) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
            hits += len(set(mine) & set(w))
        assert hits >= 0.9 * 10 * len(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, None), (21, [nan, 1.0]), (22, [inf, 1.0]), (23, [0.0, 0.0]), (24, [None, 1.0]), (25, []), (None, [1.0, 1.0]), (40, [1.0]), (1, [0.5, 0.5]), (60, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.filter("vec_id % 20 == 0")).collect())
    assert got == [(0, 1, 60, 1.0), (0, 2, 1, 0.5), (60, 1, 0, 1.0), (60, 2, 1, 0.5)]
    none = df.limit(0)
    assert nearest(none, none).count() == 0 and nearest(df, none).count() == 0


def answers(spark, rows, k=20):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    got = {i: [] for i, _ in asked}
    for r in nearest(df, df.filter("vec_id % 20 == 0"), k=k).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return got, brute(rows, asked, k)


def recall(got, want):
    """Share of the wanted answers that were found; all found ones have their exact scores."""
    for q, found in got.items():
        assert len(found) == len(want[q])
        exact = dict(want[q])
        assert all(exact.get(i, s) == s for i, s in found) and found == sorted(found, key=lambda p: (-p[1], p[0]))
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_uneven_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    one = np.ones((1200, 1))
    one[7] = 100
    for norm in (np.exp(rng.normal(size=(1200, 1))), one):
        assert recall(*answers(spark, list(enumerate(x * norm)))) >= 0.9


def measured(spark, x, every):
    """Recall by the hashing alone, whose lists were never short, and inner products made as a share of all."""
    count = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.astype(np.float32).tolist()}), "vec_id long, embedding array<float>")
    got = nearest(df, df.filter(F.col("vec_id") % every == 0), compared=count).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, found in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(found["vec_id"]) & set(np.argpartition(-score, 20)[:20].tolist()))
    n = -(-len(x) // every)
    return hits / 20 / n, count.value / n / len(x)


def test_recall_of_the_hashing(spark):
    rng = np.random.default_rng(9)
    for n in (2000, 50_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        found, share = measured(spark, x, n // 100)
        print(f"{n} vectors: recall {found:.3f}, inner products {share:.2f} of all")
        assert found >= 0.9


def test_uneven_norms_meet_fewer_vectors(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20_000, 64))
    x *= np.exp(rng.normal(size=(20_000, 1))) / np.linalg.norm(x, axis=1)[:, None]
    found, share = measured(spark, x, 200)
    print(f"norms of e ** N(0, 1): recall {found:.3f}, inner products {share:.2f} of all")
    assert found >= 0.9 and share < 0.5


def test_short_lists_of_small_tables(spark):
    x = np.random.default_rng(4).normal(size=(41, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = list(enumerate(x)) + [(100 + i, v) for i, v in enumerate(np.eye(3))]
    for k in (20, 60):
        got, want = answers(spark, rows, k)
        assert {q: len(a) for q, a in got.items()} == {q: len(a) for q, a in want.items()}
    assert got == want


def test_repeated_rows_leave_room_for_equal_vectors(spark):
    v = np.array([0.6, 0.8])
    got, want = answers(spark, [(1, v)] * 50 + [(i, v) for i in range(2, 6)] + [(20, v)] * 30)
    assert got == want and [i for i, _ in got[20]] == [1, 2, 3, 4, 5]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    got = {}
    for r in op1_nearest(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = ids[ids % 20 == 0]
    hits = 0
    for q in asked:
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        hits += len(got[q] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert got.keys() == set(asked.tolist()) and hits >= 0.9 * 20 * len(asked)
    print(f"recall {hits / 20 / len(asked):.3f}")


def test_a_smaller_share_of_more_vectors_is_met():
    rng, shares = np.random.default_rng(0), []
    for n, asked in ((3000, 40), (30_000, 20), (140_000, 10)):
        v = rng.normal(size=(n, 64))
        v /= np.linalg.norm(v, axis=1)[:, None]
        depth, first, probes = plan_of(n, 128, 4096)
        seen = np.zeros((asked, n), bool)
        for _, axes in _axes_of(v, Rotations(64, 5 * depth, 7), range(5), depth):
            own = [y.argmax(axis=1) for y in axes]
            if depth == 1:
                near = np.argpartition(-axes[0][:asked], first - 1, axis=1)[:, :first]
                for i in range(asked):
                    seen[i] |= np.isin(own[0], near[i])
            else:
                for i, one, two in _best_probes([y[:asked] for y in axes], first, probes):
                    seen[i] |= (own[0] == one) & np.isin(own[1], two)
        score = v[:asked] @ v.T
        score[np.arange(asked), np.arange(asked)] = -9
        top = np.argpartition(-score, 20, axis=1)[:, :20]
        assert np.mean([seen[i, top[i]].mean() for i in range(asked)]) >= 0.9
        shares.append(seen.mean())
    assert plan_of(140_000, 128, 4096)[0] == 2 and shares[0] > 1.2 * shares[1] > 1.8 * shares[2]


def test_two_axes_a_table(spark):
    """Buckets divided by a second axis: forced by a small block."""
    x = np.random.default_rng(5).normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.filter("vec_id % 20 == 0"), k=10, block=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, rows[::20], 10)
    assert plan_of(900, 16, 60)[0] == 2
    assert all([x[0] for x in sorted(g)] == list(range(1, 11)) for g in got.values())
    assert sum(len({v for _, v, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)
