"""Toxicity: the learner against a loop over dictionaries, quality on held-out rows, and edge cases."""

import math
import os
import zlib

import numpy as np
import pytest
from fleetlens.llm.queries import op10_toxicity
from fleetlens.llm.toxicity import Ftrl, _pack, _unpack, fit, score, train

SF = "/root/testdata/sf0.1"


def test_learner_against_a_plain_loop():
    rng = np.random.default_rng(4)
    bits, alpha, beta, l1, l2 = 8, 0.3, 1.0, 0.4, 1.0
    rows = [(np.append(np.unique(rng.integers(0, 256, 30)).astype(np.uint32), np.uint32(256)), int(rng.random() < 0.3)) for _ in range(200)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(9)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            w = {int(i): weight(int(i)) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    model = fit(rows, bits, alpha, l1, 3, 9)
    assert np.allclose(model.weights(np.arange(257)), [weight(i) for i in range(257)], rtol=0, atol=1e-9)
    at, y = rows[0]
    p = 1 / (1 + math.exp(-sum(weight(int(i)) for i in at)))
    assert math.isclose(model.loss(at, y), -math.log(p if y else 1 - p)) and Ftrl(bits).loss(at, 1) == math.log(2)


def test_features_survive_packing():
    for f in ([], [0], [65534, 65535, 65536, 131070, 131071, 1 << 20], [7, 1 << 20]):
        assert _unpack(_pack(np.array(f, np.uint32))).tolist() == f


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_quality(spark):
    got = {r.doc_id: r for r in op10_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    rows = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null").collect() if got[r.doc_id].held_out]
    bad, fine = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((b > f) + 0.5 * (b == f) for b in bad for f in fine) / (len(bad) * len(fine))
    caught = sum(s >= 0.5 for s in bad)
    print(f"AUC {auc:.3f}, recall {caught / len(bad):.3f}, precision {caught / max(1, caught + sum(s >= 0.5 for s in fine)):.3f} of {len(rows)}")
    assert auc > 0.95 and caught > 0.7 * len(bad) and sum(s >= 0.5 for s in fine) < 0.01 * len(fine)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5, 1, 2), (2, "", 0.1, 1, 2), (3, "bad " * 100_000, 0.2, 1, 2), (3, "fine", 0.3, 1, 2), (None, "fine words", 0.0, 1, 2)], "doc_id long, text string, score double, y int, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(docs, train(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert score(docs, train(docs, some)).count() == 5
    assert score(docs.limit(0), train(docs.limit(0), some)).count() == 0
