"""File sources, sinks and streams on small files of their own."""

import json
import zlib

import pytest
from fleetlens.operators import policy, similar
from fleetlens.sources import files as src
from fleetlens.sources import text as txt
from fleetlens.sources.shared import few_listings
from fleetlens.streaming import streams as st
from pyspark.sql import functions as F


def test_scan_renders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps({"at": "2024", "w": 4, "perTile": {"ms": [5, 6], "bytes": [1, 2]}, "light": {"mean": 3.5}, "G": {"a": 1}}, indent=1))
    (tmp_path / "bad.json").write_text('{"w": 4, ')
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "skip.txt").write_text("x")
    df = src.scan_renders(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r for r in df.collect()}
    assert {k: v.refused for k, v in got.items()} == {"one.json": None, "bad.json": "unreadable", "none.json": "no record"}
    assert got["one.json"].light.mean == 3.5 and got["one.json"].h is None and got["one.json"].G == {"a": "1"}
    assert [(r["pass"], r.ms, r.bytes) for r in src.render_tiles(df).collect()] == [(1, 5, 1), (2, 6, 2)]
    assert src.pass_trace(df).count() == 0


def test_tails(spark, tmp_path):
    meta = json.dumps({"a": "}{\"", "b": {"c": 1}})
    (tmp_path / "x.bin").write_bytes(b"\xff\x00" * 5000 + b"META:" + meta.encode() + b"\x00" * 3000)
    (tmp_path / "y.bin").write_bytes(b"nothing META:{ here")
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("x.bin", "y.bin")], "p string")
    got = {r.path[-5:]: r for r in src.extract_from_tails(df, "p", "META:", step=512).collect()}
    assert json.loads(got["x.bin"].meta) == json.loads(meta) and got["x.bin"].start == 10005 and got["y.bin"].meta is None


def test_sensor_csv_and_lines(spark, tmp_path):
    (tmp_path / "log.csv").write_bytes('"Date","Time","CPU [%]","T [°C]","Flag",\n1.2.2024,3:04:05.678,"12,5",40,Yes,\n1.2.2024,3:04:07.678,13\n'.encode("latin-1"))
    got = {(r.ts.second, r.sensor): r.value for r in src.scan_sensor_csv(spark, str(tmp_path / "log.csv")).collect()}
    assert got == {(5, "CPU [%]"): 12.5, (5, "T [°C]"): 40.0, (5, "Flag"): 1.0, (7, "CPU [%]"): 13.0, (7, "T [°C]"): None, (7, "Flag"): None}
    (tmp_path / "p.jsonl").write_text('{"t":"a","cpu":1.5}\n\nbroken\n{"t":"b"}\n')
    assert [(r.t, r.cpu) for r in src.scan_jsonl(spark, str(tmp_path / "p.jsonl"), "t string, cpu double").collect()] == [("a", 1.5), ("b", None)]
    assert src.count_bad_lines(spark, str(tmp_path / "p.jsonl")).collect()[0].bad == 1


def test_tiles(spark, tmp_path):
    px = bytes(range(12))
    z = zlib.compress(px)
    (tmp_path / "t.bin").write_bytes(b"xxxx" + z + b"junk")
    rows = [(str(tmp_path / "t.bin"), 0, 4, len(z), 8), (str(tmp_path / "t.bin"), 1, 4 + len(z), 4, 32946), (str(tmp_path / "t.bin"), 2, 0, 4, 5)]
    tiles = src.scan_tiles(spark.createDataFrame(rows, "path string, idx int, offset long, length long, codec int"))
    got = {r.idx: r for r in tiles.collect()}
    assert bytes(got[0].px) == px and got[1].reason == "error" and got[2].reason == "codec 5"
    assert {(r.x, r.y): (r.q0, r.q2, r.q3) for r in src.tile_pixels(tiles, 2, 3).collect()}[1, 1] == (9, 11, None)


def test_packs(spark, tmp_path):
    (tmp_path / "de.json").write_text('{"a": "x", "n": {"one": "1", "other": "2"}}')
    (tmp_path / "_index.json").write_text('{"a": "x"}')
    got = sorted((r.lang, r.key, r.form or "", r.text) for r in txt.scan_packs(spark, str(tmp_path)).collect())
    assert got == [("de", "a", "", "x"), ("de", "n", "one", "1"), ("de", "n", "other", "2")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "name string, body string")
    policy.write_sidecars(rows, str(tmp_path / "s"), "name", "body")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        policy.write_sidecars(rows.union(spark.createDataFrame([("a", "z")])), str(tmp_path / "t"), "name", "body")
    policy.export_stats_csv(rows, str(tmp_path / "c"), ["body", "none"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["body", "none"]
    log = rows.withColumn("t", F.monotonically_increasing_id() * 0 + 5)
    windows = rows.select("name").distinct().withColumns({"t0": F.lit(5), "t1": F.lit(5)})
    policy.split_log_by_render(log.drop("name"), windows, str(tmp_path / "l"), "name")
    assert {p.name for p in (tmp_path / "l").iterdir() if "=" in p.name} == {"name=a", "name=b"}


def test_split_log_is_as_sparks_writer_has_it(spark, tmp_path):
    """Folders, lines and header equal those of partitionBy, for odd names and values; tasks write them without Spark's writer, and few tasks list them."""
    names = ["a", "", None, "a=b/c d", "50%", "q\"'", "\u00fc[x]^{y}:*?#\\", "z\x01\x7f"]
    texts = ["x,y", None, "", 'say "so"', " padded ", "\u00e9", "back\\slash", "#"]
    rows = [(i, names[i % 8], texts[i // 8 % 8], i / 4 if i % 5 else None) for i in range(160)]
    log = spark.createDataFrame(rows, "i long, own string, `a,text` string, v double").withColumns({"t": F.col("i"), "at": F.timestamp_seconds(F.col("i") / 8 + 1_700_000_000)})
    windows = spark.createDataFrame([(k,) for k in names], "render string").withColumns({"t0": F.lit(3), "t1": F.lit(140)})
    windows = windows.filter("render is null or render <> 'a'")

    def read(path):
        out = {}
        for f in path.rglob("*.csv"):
            head, *lines = f.read_text().splitlines()
            out.setdefault((f.parent.name, head), []).extend(lines)
        return {k: sorted(v) for k, v in out.items()}

    both = log.join(windows, F.col("t").between(F.col("t0"), F.col("t1"))).select("render", *log.columns)
    both.write.partitionBy("render").csv(str(tmp_path / "want"), header=True)
    at = tmp_path / "odd %20 name"
    (at / "render=old").mkdir(parents=True)
    (at / "render=old" / "x.csv").write_text("gone")
    policy.split_log_by_render(log, windows, str(at), "render")
    assert read(at) == read(tmp_path / "want") and len(read(at)) == 6
    assert {p.name for p in at.iterdir() if "=" not in p.name} <= {"_SUCCESS", "._SUCCESS.crc"}
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("odd")] == [at.name]
    assert not list(at.rglob("render=*/.*"))  # no sums beside each file
    policy.split_log_by_render(log, windows.limit(0), str(at), "render")
    assert (at / "_SUCCESS").exists() and not read(at)


def test_listings_are_few_and_the_setting_comes_back(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with few_listings(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before


def polls(spark):
    rows = [("a", 0, 5), ("b", 0, 1), ("a", 1, 5), ("b", 1, 2), ("a", 2, 9), ("a", 3, 9), ("b", 2, 3)]
    return spark.createDataFrame(rows, "path string, s long, size long").select("path", F.timestamp_seconds(F.col("s") * 60 + 1_700_000_000).alias("t"), "size")


def test_settled_stream_equals_batch(spark, tmp_path):
    df = polls(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.settled_arrivals_stream(stream).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("settled").collect()) == sorted(st.settled_arrivals(df).select("path", "t", "size").collect())


def test_rates_and_history_streams(spark, tmp_path):
    df = polls(spark).select(F.col("path").alias("key"), "t", F.col("size").cast("double").alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.event_rates(stream, "t", "key", "2 minutes", "1 minute", 120.0, "1 minute").writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("rates").collect()) == sorted(st.event_rates(df, "t", "key", "2 minutes", "1 minute", 120.0).collect())
    q = st.bounded_history_stream(stream, "10 minutes", 3).writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.n, r.full) for r in spark.table("history").collect()) == [("a", 3, True), ("b", 3, False)]


def test_images_are_written_one_at_a_time(spark, tmp_path, monkeypatch):
    """A task is handed the pixels of one image, in columns, not frames of many images' pixels; pixels in any order, of other types, and gaps."""
    import pyspark.sql.classic.dataframe as classic

    monkeypatch.delattr(classic.DataFrame, "mapInPandas")
    want = {(i, x, y): (i * 31 + x * 7 + y) % 256 for i in range(5) for x in range(3 + i) for y in range(4) if (x + y) % 3 or (x, y) == (2 + i, 3)}
    rows = spark.createDataFrame([(*k, q) for k, q in want.items()], "image long, x long, y int, q int").orderBy(F.rand(1))
    src.write_images(rows, f"file://{tmp_path}/i")
    back = src.scan_images(spark, str(tmp_path / "i")).select(F.regexp_extract("image", r"(\d+)\.png", 1).cast("int").alias("i"), "x", "y", F.round(F.col("v") * 255).cast("int").alias("q")).collect()
    assert {(r.i, r.x, r.y): r.q for r in back} == {(i, x, y): want.get((i, x, y), 0) for i in range(5) for x in range(3 + i) for y in range(4)}
