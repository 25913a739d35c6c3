"""Queries over file sources and sinks: the driver tables are written out in a source's format and scanned back."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import policy
from ..sources import files as src
from ..sources import text as txt
from ..sources.shared import few_listings, scratch
from . import tables as t
from .registry import query


@query("""SELECT CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey::VARCHAR END AS inputs, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END AS w, CASE WHEN o_orderkey % 13 > 0 AND o_orderkey % 5 > 0 THEN o_orderstatus END AS state,
 CASE WHEN o_orderkey % 13 = 0 THEN 'no record' END AS refused FROM orders""")
def a1_scan_renders(spark, sf):
    """Records of orders, a JSON array of them in each file; every thirteenth is empty, every fifth has no state."""
    o = t.table(spark, sf, "orders")
    field = lambda c, keep: F.when((F.col("o_orderkey") % 13 > 0) & keep, F.col(c))
    every = F.lit(True)
    record = F.to_json(F.struct(field("o_orderkey", every).cast("string").alias("inputs"), field("o_custkey", every).alias("w"), field("o_orderstatus", F.col("o_orderkey") % 5 > 0).alias("state")))

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in batches:
            lines = [("," if begun or i else "[") + x for i, x in enumerate(b.column(0).to_pylist())]
            begun = begun or bool(lines)
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        if begun:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    path = scratch(spark, "renders")
    o.select(record.alias("value")).mapInArrow(array, "value string").write.text(path)
    return src.scan_renders(spark, path, "txt").select("inputs", "w", "state", "refused")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at, 'value [%]' AS sensor, value FROM events UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), 'on', (event_id % 2)::DOUBLE FROM events""")
def a3_scan_sensor_csv(spark, sf):
    """Events as a wide log of one reading and one switch."""
    path = scratch(spark, "log")
    e = t.table(spark, sf, "events")
    text = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    wide = e.select(F.date_format("ts", "d.M.yyyy").alias("Date"), F.date_format("ts", "H:m:s.SSS").alias("Time"), text.alias("value [%]"), F.when(F.col("event_id") % 2 == 1, "Yes").otherwise("No").alias("on"))
    wide.write.csv(path, header=True, encoding="ISO-8859-1")
    return src.scan_sensor_csv(spark, path).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "sensor", "value")


@query("""SELECT o_orderkey AS id, o_totalprice AS cpu, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS state FROM orders WHERE o_orderkey % 17 > 0""")
def a4_scan_jsonl(spark, sf):
    """Orders as JSON lines; every seventeenth is cut off in the middle or blank."""
    path = scratch(spark, "lines")
    o = t.table(spark, sf, "orders")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("cpu"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("state")))
    o.select(F.when(F.col("o_orderkey") % 17 > 0, line).when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit('{"id": '), F.col("o_orderkey")))).write.text(path)
    return src.scan_jsonl(spark, path, "id long, cpu double, state string")


@query(f"""WITH {t.LEVELS} SELECT image AS idx, x, y, q AS q0 FROM levels WHERE image % 7 > 0""")
def a5_scan_tiles(spark, sf):
    """Rasters as deflated tiles of one sample, many to a file, with a directory of their places; every seventh has another codec."""
    path, listing = scratch(spark, "tiles"), scratch(spark, "directory")
    px = t.levels(spark, sf).groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "q"))), lambda p: p["q"]).alias("px"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        name, at, rows = f"{uuid.uuid4().hex}.bin", 0, []
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for f in frames:
                for image, values in zip(f["image"], f["px"], strict=True):
                    data = zlib.compress(bytes(values.astype("uint8")))
                    out.write(data)
                    rows.append((f"{path}/{name}", image, at, len(data), 8 if image % 7 else 5))
                    at += len(data)
        yield pd.DataFrame(rows, columns=["path", "idx", "offset", "length", "codec"])

    px.mapInPandas(write, "path string, idx long, offset long, length long, codec int").write.parquet(listing)
    return src.tile_pixels(src.scan_tiles(spark.read.parquet(listing)), 8, 1).select("idx", "x", "y", "q0")


@query("""SELECT lang, doc_id::VARCHAR AS key, NULL AS form, text FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT lang, doc_id::VARCHAR, 'one', source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT lang, doc_id::VARCHAR, 'other', text FROM documents WHERE doc_id % 3 = 0""")
def a8_scan_packs(spark, sf):
    """Documents as message packs, fifty ids a folder and a file a language; every third message has plural forms."""
    path = scratch(spark, "packs")

    def write(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(f"{path}/{key[0]}")
        fs.create_dir(folder, recursive=True)
        pack = {str(d): text if d % 3 else {"one": source, "other": text} for d, text, source in zip(f["doc_id"], f["text"], f["source"], strict=True)}
        with fs.open_output_stream(f"{folder}/{key[1]}.json") as out:
            out.write(json.dumps(pack).encode())
        return pd.DataFrame({"n": [len(pack)]})

    docs = t.table(spark, sf, "documents").select(F.expr("doc_id div 50").alias("folder"), "lang", "doc_id", "text", "source")
    docs.groupBy("folder", "lang").applyInPandas(write, "n long").agg(F.sum("n")).first()
    return txt.scan_packs(spark, f"{path}/*")


@query("""SELECT o_orderkey, NULL::VARCHAR AS note, o_orderstatus, o_totalprice FROM orders""")
def a13_export_stats_csv(spark, sf):
    path = scratch(spark, "stats")
    policy.export_stats_csv(t.table(spark, sf, "orders"), path, ["o_orderkey", "note", "o_orderstatus", "o_totalprice"])
    return spark.read.csv(path, header=True, schema="o_orderkey long, note string, o_orderstatus string, o_totalprice double")


@query(f"""WITH {t.SAMPLES}, w AS (SELECT series AS render, min(t) AS t0, max(t) AS t1 FROM samples WHERE kind = 'purchase' GROUP BY 1) SELECT render, id, kind, value, t FROM samples JOIN w ON series = render AND t BETWEEN t0 AND t1""")
def a14_split_log_by_render(spark, sf):
    """A user's events from the first purchase to the last, a folder each."""
    path, s = scratch(spark, "split"), t.samples(spark, sf)
    windows = s.filter("kind = 'purchase'").groupBy(F.col("series").alias("render")).agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("series", F.col("render"))
    policy.split_log_by_render(s, windows, path, "render", by=("series",))
    kinds = dict(s.dtypes)
    with few_listings(spark):
        back = spark.read.csv(path, header=True, schema=f"id {kinds['id']}, series {kinds['series']}, t long, kind string, value double, render {kinds['series']}")
    return back.select("render", "id", "kind", "value", "t")


@query(f"""WITH {t.LEVELS} SELECT image, x, y, round(q / 255.0, 6) AS v FROM levels""")
def a6_scan_images(spark, sf):
    """Sixty-four rasters side by side are an image file each; the grey values come back from the files."""
    path, side = scratch(spark, "images"), 64
    tiles = t.levels(spark, sf).select((F.col("image") / side).cast("long").alias("image"), (F.col("image") % side * 8 + F.col("x")).alias("x"), "y", "q")
    src.write_images(tiles, path)
    back = src.scan_images(spark, path).withColumn("file", F.regexp_extract("image", r"(\d+)\.png$", 1).cast("long"))
    known = t.levels(spark, sf).select("image").distinct()  # the last file may have room for more
    out = back.select((F.col("file") * side + F.expr("x div 8")).alias("image"), (F.col("x") % 8).cast("int").alias("x"), "y", F.round("v", 6).alias("v"))
    return out.join(known, "image", "left_semi")
