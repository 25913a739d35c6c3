"""Quality: vectors, pooling and gradients against plain loops, calibration, held-out quality and edge cases."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from fleetlens.llm import quality as q
from fleetlens.llm.queries import op11_quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r]+")
TEXTS = [None, "", " \n", "one", "it's $$$ fun,\nit's é!!", "a b " * 60, "Same same same, SAME."]


def test_words_equal_a_pattern():
    for text in [*TEXTS, "x" * 70_000 + " " + "y z " * 40_000, "lone " * 30_000]:
        raw = (text or "").encode()
        words = [raw[k : k + 65536] for k in range(0, len(raw), 65536)] if " " not in raw.decode() else TOKEN.findall(raw)
        if len(raw) < 65536:
            assert len(q.word_codes(raw, 20)) == len(words)
            assert q.word_codes(raw, 30).tolist() == [q.word_codes(w, 30)[0] for w in words]
    long = q.word_codes(("lone " * 30_000).encode(), 30)
    assert len(long) == 30_000 and len(set(long.tolist())) == 1
    assert len(q.word_codes(b"x" * 200_000, 20)) == 4


def test_vectors_and_pools_against_loops(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, pooled string, score string").repartition(5)
    bits, dims, window = 11, 6, 2
    places, values = q.index_vectors(bits, dims, 3, 11)
    total = np.zeros((1 << bits, dims))
    for t in TEXTS * 3:
        codes = q.word_codes((t or "").encode(), bits).tolist()
        for i, c in enumerate(codes):
            for j in range(max(0, i - window), min(len(codes), i + window + 1)):
                if j != i:
                    for k in range(3):
                        total[c, places[codes[j], k]] += values[codes[j], k]
    size = np.linalg.norm(total, axis=1)
    want = total / np.where(size > 0, size, 1)[:, None]
    got = q.word_vectors(docs, bits=bits, dims=dims, window=window, signs=3)
    assert np.allclose(got, want, atol=1e-6)
    pooled = q.pool(docs, got)
    assert pooled.columns == ["doc_id", "text", "score", "pooled"]
    for r in pooled.collect():
        v = got[q.word_codes((r.text or "").encode(), bits)].astype(float)
        n = max(1, len(v))
        assert np.allclose(r.pooled, [*(v.sum(axis=0) / n), *((v[1:] * v[:-1]).sum(axis=0) / n), math.log1p(len(v))], atol=1e-5)


def test_pools_of_long_texts_do_not_depend_on_pieces(spark, monkeypatch):
    words = " ".join(f"w{i % 97}" for i in range(70_000))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    vectors = np.random.default_rng(2).normal(size=(1 << 10, 4)).astype(np.float32)
    got = q.pool(docs, vectors).first().pooled
    v = vectors[q.word_codes(words.encode(), 10)].astype(float)
    assert np.allclose(got, [*v.mean(axis=0), *((v[1:] * v[:-1]).sum(axis=0) / len(v)), math.log1p(len(v))], atol=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 5)), (rng.random(20) < 0.5).astype(float)
    layers = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]

    def loss(p):
        z = np.tanh(x @ p[0] + p[1]) @ p[2] + p[3][0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + 0.05 * ((p[0] ** 2).sum() + (p[2] ** 2).sum()))

    for i, g in enumerate(q.gradients(layers, x, y, 0.1)):
        for at in np.ndindex(layers[i].shape):
            up, down = [p.copy() for p in layers], [p.copy() for p in layers]
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            assert math.isclose((loss(up) - loss(down)) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-7)


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 40_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    for t in (0.5, 1.0, 3.0):
        assert abs(q.best_temperature(z * t, y) / t - 1) < 0.05


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_quality(spark):
    got = {r.doc_id: r for r in op11_quality(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    rows = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").collect() if got[r.doc_id].held_out]
    good, bad = np.array([s for s, y in rows if y]), np.array([s for s, y in rows if not y])
    auc = float(np.mean(good[:, None] > bad[None]))
    s, y = np.array([s for s, _ in rows]), np.array([y for _, y in rows])
    bins = [(s[i].mean(), y[i].mean(), i.sum()) for lo in np.arange(0, 1, 0.1) if (i := (s >= lo) & (s < lo + 0.1 + 1e-9)).sum()]
    off = sum(abs(a - b) * n for a, b, n in bins) / len(rows)
    print(f"AUC {auc:.4f}, kept {np.mean(good >= 0.7):.4f} of good, {np.mean(bad >= 0.7):.4f} of bad, calibration error {off:.4f} of {len(rows)}")
    assert auc > 0.98 and np.mean(good >= 0.7) > 0.97 and np.mean(bad >= 0.7) < 0.1 and off < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "bad " * 100_000, 2), (3, "fine", 2), (None, "fine words", 2)], "doc_id long, text string, y int")
    pooled = q.pool(docs, q.word_vectors(docs))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.train(pooled, none) is None and [r.score for r in q.score(pooled, None).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    model = q.train(pooled, some)
    got = q.score(pooled.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and not any(math.isnan(r.score) for r in got)
    empty = docs.limit(0)
    vectors = q.word_vectors(empty)
    assert not vectors.any() and q.score(q.pool(empty, vectors), model).count() == 0
