"""Queries that have no SQL, and a few more, against plain Python over the small tables."""

import hashlib
import json
import math
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from fleetlens.functions.scalars import state_signature
from fleetlens.operators import raster, similar, text
from fleetlens.plans import tables as t
from fleetlens.plans.registry import QUERIES
from fleetlens.sources import files as src
from fleetlens.streaming import streams as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_b12_state_signature(spark):
    got = {r.o_orderkey: r.signature for r in QUERIES["b12_state_signature"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/orders.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = f'{{"o_custkey":{r.o_custkey},"o_totalprice":{r.o_totalprice!r},"col3":{json.dumps(r.o_orderpriority) if r.o_orderstatus == "F" else "null"}}}'
        assert got[r.o_orderkey] == f"{zlib.crc32(body.encode()):x}"
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "x int, y string")
    want = [f"{zlib.crc32(b):X}".lower() if b else None for b in (b'{"x":1,"y":"a"}', b'{"x":null,"y":"b"}', None)]
    assert [r.s for r in df.select(state_signature(F.col("x"), F.col("y")).alias("s")).collect()] == want


@needs_tables
def test_b16_fold_text(spark):
    def fold(s):
        plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not "\u0300" <= c <= "\u036f")
        return re.sub("[-\u2010-\u2015\\s]+", " ", unicodedata.normalize("NFC", plain)).strip(" ")

    got = {r.doc_id: (r.folded, r.starts_et) for r in QUERIES["b16_fold_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        f = fold(r.text)
        assert got[r.doc_id] == (hashlib.md5(f.encode()).hexdigest(), bool(re.search(r"(?<![^\W_])et", f)))


@needs_tables
def test_d39_tile_checksums(spark):
    px = {}
    for r in t.levels(spark, SF).collect():
        px.setdefault(r.image, {})[r.y, r.x] = r.q
    got = {r.image: (r["mean"], r.lo, r.hi, r.crc, r.flat) for r in QUERIES["d39_tile_checksums"](spark, SF).collect()}
    assert got.keys() == px.keys()
    for image, p in px.items():
        v = [p[k] for k in sorted(p)]
        mean, *rest = got[image]
        assert math.isclose(mean, sum(v) / len(v)) and tuple(rest) == (min(v), max(v), zlib.crc32(bytes(v)), min(v) == max(v))


@needs_tables
def test_d56_width_breaks(spark):
    def breaks(widths, k=3):
        x = sorted(math.log(w + 1e-6) for w in widths if w >= 0)
        if len(x) < k:
            return []
        c = np.quantile(x, [0.15, 0.5, 0.85]).tolist()
        for _ in range(40):
            own = [min(range(k), key=lambda i: abs(v - c[i])) for v in x]
            new = [sum(v for v, o in zip(x, own, strict=True) if o == i) / own.count(i) if i in own else c[i] for i in range(k)]
            done = max(abs(a - b) for a, b in zip(c, new, strict=True)) <= 1e-12
            c = new
            if done:
                break
        return [math.exp((a + b) / 2) for a, b in zip(c, c[1:], strict=False)]

    widths = {}
    for r in t.components(spark, SF).collect():
        widths.setdefault(r.image, []).append(float(r.width))
    got = {r.image: r.breaks for r in similar.width_breaks(t.components(spark, SF)).collect()}
    assert got.keys() == widths.keys()
    for image, w in widths.items():
        assert np.allclose(got[image], breaks(w), rtol=1e-6)


def circles(f, least, most, inner=24, outer=48):
    depth, across = len(f), len(f[0])
    best = None
    for cy in range(depth):
        for cx in range(across):
            ring = {(x, y): int(math.hypot(x - cx, y - cy)) for y in range(depth) for x in range(across)}
            for r in range(least, most - 5):
                far = min(most, r + max(4, r >> 1))
                a = [f[y][x] for (x, y), d in ring.items() if d <= r]
                b = [f[y][x] for (x, y), d in ring.items() if r + 2 <= d <= far]
                if len(a) < inner or len(b) < outer:
                    continue
                mean = sum(b) / len(b)
                sd = math.sqrt(sum((v - mean) ** 2 for v in b) / (len(b) - 1))
                z = (sum(a) / len(a) - mean) / sd
                if best is None or z > best[0]:
                    best = (z, cx, cy, r)
    return best


def test_w11_radial_step(spark):
    rng = np.random.default_rng(5)
    plain, disc = rng.normal(size=(21, 22)), rng.normal(size=(21, 22))
    disc[np.hypot(*np.mgrid[-10:11, -12:10]) <= 4] += 6
    rows = [(i, x, y, float(f[y, x])) for i, f in ((0, disc), (1, plain), (2, np.zeros((4, 4)))) for y in range(f.shape[0]) for x in range(f.shape[1])]
    fits = raster.radial_step(spark.createDataFrame(rows, "image long, tx int, ty int, v double"))
    got = {r.image: r for r in fits.collect()}
    assert got.keys() == {0, 1}
    for i, f in ((0, disc), (1, plain)):
        z, cx, cy, r = circles(f.tolist(), 3, 10)
        assert (got[i].cx, got[i].cy, got[i].r) == (cx, cy, r) and math.isclose(got[i].z, z) and got[i].edge == min(cx, 21 - cx, cy, 20 - cy)
    assert (got[0].cx, got[0].cy) == (12, 10)
    fits = fits.withColumn("pair", F.lit(0))
    verdict = lambda a, b: [r.verdict for r in raster.radial_verdict(fits.filter(a), fits.filter(b)).collect()]
    assert verdict("image = 0", "image = 1") == ["separated"] and verdict("image = 0", "image = 0") == ["too close"] and verdict("image = 0", "image = 9") == ["unproven"]


def test_w11_refines_a_coarse_grid():
    f = np.random.default_rng(6).normal(size=(100, 130))
    f[np.hypot(*np.mgrid[-37:63, -51:79]) <= 9] += 5
    z, cx, cy, r = raster._best_circle(f, 24, 48)
    assert (cx, cy) == (51, 37) and abs(r - 9) <= 1 and z > 3


def test_w11_sums_many_centres_at_once(monkeypatch):
    """A sheet of 24 x 24 takes a few sums, not some for each of its 576 centres; the same circle at any number of centres a time."""
    f = np.random.default_rng(7).normal(size=(24, 24))
    f[np.hypot(*np.mgrid[-9:15, -13:11]) <= 4] += 2
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or count(*a, **b))
    assert raster._best_circle(f, 24, 48)[1:] == circles(f.tolist(), 3, 11, 24, 48)[1:] and len(calls) <= 3
    assert raster._best_circle(f * 0, 24, 48) is None and raster._best_circle(f * np.nan, 24, 48) is None


@needs_tables
def test_q8_keep_terms(spark):
    rows = spark.createDataFrame([(1, "The Slate is old, the slates-set"), (2, "no word"), (3, "a translate")], "id long, text string")
    target = spark.createDataFrame([(1, "de", "Der SLATE"), (1, "fr", "La roche"), (3, "de", "x")], "id long, lang string, text string")
    glossary = spark.createDataFrame([("slate", "de", "Slate"), ("slate", "fr", "ardoise"), ("the slate", "fr", "roche"), ("slat", "fr", "och")], "term string, lang string, form string")
    assert sorted(map(tuple, text.keep_terms(rows, target, glossary, "id", "text").collect())) == [(1, "fr", "slat"), (1, "fr", "slate")]


def png(path, rows):
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]) // 3, len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_a6_scan_images(spark, tmp_path):
    png(tmp_path / "a.png", [[255, 0, 0, 9, 9, 9], [0, 30, 60, 255, 255, 255]])
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {(r.x, r.y): r.v for r in src.scan_images(spark, str(tmp_path)).collect()}
    want = {(0, 0): 85 / 255, (1, 0): 9 / 255, (0, 1): 30 / 255, (1, 1): 1.0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert [(r.image.rsplit("/", 1)[1], r.reason) for r in src.refused_images(spark, str(tmp_path)).collect()] == [("b.png", "not an image")]


def test_pairs_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(80, 5)) * 3, rng.normal(size=(60, 5)) * 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (500, None)], "id long, v array<double>")
    d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(len(x)) for j in range(i + 1, len(x))}
    for block in (7, 2048):
        got = {(r.a, r.b): r.distance for r in similar.pair_within(df, "id", "v", 0.3, block=block).collect()}
        assert got.keys() == {p for p, v in d.items() if v <= 0.3} and all(math.isclose(v, d[p]) for p, v in got.items())
    best = sorted(d, key=lambda p: (d[p], p))[:9]
    for sample in (30, 1000):
        assert [(r.a, r.b) for r in similar.nearest_pairs(df, "id", "v", 9, sample=sample).collect()] == best
    assert similar.nearest_pairs(df.limit(1), "id", "v", 3).count() == 0 and similar.pair_within(df.limit(0), "id", "v", 1.0).count() == 0


def test_tasks_of_pairs_grow_with_their_blocks(spark):
    """What a task sorts is bounded: twice the vectors in one cell are four times the pairs of blocks, over as many more tasks."""
    rng = np.random.default_rng(9)
    tasks = []
    for n in (200, 400):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 5)))], "id long, v array<double>")
        tasks.append(similar.pair_within(df, "id", "v", 50.0, block=20).rdd.getNumPartitions())
    assert tasks[0] > 4 and tasks[1] >= 3 * tasks[0]


def files(spark, folder, batches, schema):
    """One file, and so one micro-batch, of each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    kinds = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_history_stream_forgets(spark, tmp_path):
    base = 1_700_000_000
    batches = [[("a", base, 1.0)], [("b", base + 7200, 1.0)], [("b", base + 7300, 1.0)], [("b", base + 9000, 1.0)]]
    stream = files(spark, tmp_path / "in", batches, "key string, t long, value double")
    q = st.bounded_history_stream(stream, "10 minutes", 3).writeStream.format("memory").queryName("forgets").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] == 2  # the counts and the one bucket of b; a is forgotten


def test_alert_stream_says_a_path_once(spark, tmp_path):
    base = 1_700_000_000
    batches = [[("p1", "odd-1", base), ("p1", "odd-1", base + 1), ("p2", "known-1", base)], [("p1", "odd-1", base + 60), ("p3", "none", base + 60)]]
    stream = files(spark, tmp_path / "in", batches, "path string, name string, t long")
    known = spark.createDataFrame([("known",)], "prefix string")
    with pytest.raises(ValueError):
        st.unknown_shape_alerts(stream, known, "path", "name", r"^[a-z]+-\d")
    q = st.unknown_shape_alerts(stream, known, "path", "name", r"^[a-z]+-\d", "t").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.path, r.prefix) for r in spark.table("alerts").collect()] == [("p1", "odd")]
