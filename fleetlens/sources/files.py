"""File sources. Schemas are explicit and all nullable; what cannot be read becomes a refused row with a reason."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The render record: a field's absence is null and never a default.
RENDER_SCHEMA = """at string, build string, slab string, material string, family string, inputs string, state string, spectrum int, engine string,
 ua string, arch string, cores int, mem int, dpr double, maxTexture int, w bigint, h bigint, tile int, render int, tiles int, renders int, bleed int,
 sigma int, marks int, lines int, cracks int, specks int, marked int, markedCells int, resumedTiles int, workers int, bytes bigint, streamed boolean,
 light struct<mean:double,lit40:double,every:int>, ms struct<render:bigint,total:bigint>, perTile struct<ms:array<int>,bytes:array<bigint>>,
 plan struct<budgetMB:int,memShare:int,mem:int,tried:array<string>>,
 trace struct<target:int,tick:int,every:int,run:int,rows:int,capped:boolean,busy:array<int>,i:array<int>,d:array<int>,q:array<int>,r:array<int>,w:array<int>,k:array<int>,dw:array<int>,bF:array<int>>,
 G map<string,string>"""


def scan_renders(spark: SparkSession, path: str, extension: str = "json") -> DataFrame:
    """Records below ``path`` by extension, one JSON object a file: file, refused (reason or null) and the record's fields."""
    df = (
        spark.read.schema(f"{RENDER_SCHEMA}, _bad string")
        .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").json(path)
    )
    refused = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.col("w").isNull() & F.col("at").isNull(), "no record")
    return df.select(F.col("_metadata.file_path").alias("file"), refused.alias("refused"), *[c for c in df.columns if c != "_bad"])


def render_tiles(renders: DataFrame) -> DataFrame:
    """One row per pass of the parallel arrays: file, pass (from 1), ms, bytes. Arrays of different length are padded with null."""
    return renders.select("file", F.posexplode(F.arrays_zip(F.col("perTile.ms").alias("ms"), F.col("perTile.bytes").alias("bytes"))).alias("_p", "_t")).select("file", (F.col("_p") + 1).alias("pass"), "_t.ms", "_t.bytes")


def pass_trace(renders: DataFrame) -> DataFrame:
    """One row per kept pass of the trace; absent arrays give null columns."""
    names = ["i", "d", "q", "r", "w", "k", "dw", "bF"]
    t = renders.filter("trace is not null").select("file", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"trace.{n}"), F.array().cast("array<int>")).alias(n) for n in names])).alias("seq", "_t"))
    return t.select("file", "seq", *[F.col(f"_t.{n}").alias(n) for n in names])


#: What matters in a JSON text: whole strings, a quote that is not closed, braces.
_JSON_PARTS = re.compile(r'"(?:[^"\\]++|\\.)*+"|["{}]', re.S)


def match_braces(text: str, start: int) -> int:
    """End of the JSON object that begins at ``start``, minding strings and escapes; -1 if it does not end."""
    depth = 0
    for part in _JSON_PARTS.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if part[0] == '"':
            return -1
        if part[0] == "}" and depth == 0:
            return part.end()
    return -1


def last_object(text: str, marker: str) -> tuple[str, int, int] | None:
    """The JSON object right after the last marker that is followed by one which parses: (object, start, end)."""
    at = len(text)
    while (at := text.rfind(marker, 0, at)) >= 0:
        start = text.find("{", at + len(marker))
        end = match_braces(text, start) if start >= 0 else -1
        if end > 0:
            try:
                json.loads(text[start:end])
                return text[start:end], start, end
            except ValueError:
                pass
    return None


def extract_embedded_json(rows: DataFrame, key: str, body: str, marker: str) -> DataFrame:
    """The last embedded object of each text: key, meta (JSON), start, end in code points; all null where there is none."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [last_object(x, marker) if isinstance(x, str) else None for x in f["b"]]
            yield pd.DataFrame({"k": f["k"], "meta": [x and x[0] for x in found], "start": pd.array([x[1] if x else None for x in found], "Int64"), "end": pd.array([x[2] if x else None for x in found], "Int64")})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(go, f"k {kind}, meta string, start long, end long").withColumnRenamed("k", key)


def extract_from_tails(files: DataFrame, path: str, marker: str, step: int = 4 << 20, most: int = 1 << 30, tasks: int | None = None) -> DataFrame:
    """The same from the ends of files, read backwards in steps and no further than needed: path, meta, start, end in bytes. The listing is
    dealt over tasks; paths are URIs that Arrow opens. Each step reads its block alone and looks for markers there. Files without an
    object give nulls."""
    mark = marker.encode("utf-8")

    def one(uri: str) -> tuple[str, int, int] | None:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
        with fs.open_input_file(at) as f:
            size = f.size()
            begin, blocks = size, []  # what was read so far, from ``begin`` on, the last block first
            while begin > max(0, size - most):
                step_begin = max(0, begin - step, size - most)
                f.seek(step_begin)
                new = f.read(begin - step_begin)
                blocks.append(new)
                begin = step_begin
                over = b"".join(b[: len(mark)] for b in reversed(blocks[-3:-1]))[: len(mark) - 1]
                places = new + over  # markers that begin in the new block; later ones were tried before
                k = len(places)
                while (k := places.rfind(mark, 0, k)) >= 0:
                    text = b"".join([new[k:], *reversed(blocks[:-1])]).decode("latin-1")
                    opened = text.find("{", len(mark))
                    end = match_braces(text, opened) if opened >= 0 else -1
                    if end > 0:
                        try:
                            json.loads(text[opened:end])
                            return text[opened:end].encode("latin-1").decode("utf-8", "replace"), begin + k + opened, begin + k + end
                        except ValueError:
                            pass
        return None

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [one(p) for p in f["path"]]
            yield pd.DataFrame({"path": f["path"], "meta": [x and x[0] for x in found], "start": pd.array([x[1] if x else None for x in found], "Int64"), "end": pd.array([x[2] if x else None for x in found], "Int64")})

    listing = files.select(F.col(path).alias("path"))
    listing = listing.repartition(tasks, "path") if tasks else listing
    return listing.mapInPandas(go, "path string, meta string, start long, end long")


def scan_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide sensor log (ISO-8859-1, quoted headers, Date d.M.yyyy and Time H:m:s.SSS) as (log, ts, sensor, value): commas are decimal points,
    Yes and No are 1 and 0, short rows have nulls and unreadable numbers are null."""
    wide = spark.read.csv(path, header=True, encoding="ISO-8859-1", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True)
    sensors = [c for c in wide.columns if c not in ("Date", "Time") and not c.startswith("_c")]
    ts = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("d.M.yyyy H:m:s.SSS"))
    rows = wide.select(F.col("_metadata.file_path").alias("log"), ts.alias("ts"), *[F.col(f"`{c}`") for c in sensors])
    tall = rows.unpivot(["log", "ts"], sensors, "sensor", "_v")
    value = F.when(F.lower("_v") == "yes", 1.0).when(F.lower("_v") == "no", 0.0).otherwise(F.expr("try_cast(replace(_v, ',', '.') as double)"))
    return tall.filter("ts is not null").select("log", "ts", "sensor", value.alias("value"))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON object, by file; blank lines do not count."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v")).filter("v <> ''")
    return lines.groupBy("file").agg(F.count_if(F.try_parse_json("v").isNull()).alias("bad"))


def scan_tiles(directory: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """Directory rows (path, idx, offset, length, codec) as inflated buffers: path, idx, px, reason. Only deflate (8 and 32946) is read;
    anything else, and what does not inflate, has a reason. A file's rows are read in the order of their offsets."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for f in frames:
            px, why = [], []
            for uri, rows in f.groupby("path", sort=False):
                fs, at = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                with fs.open_input_file(at) as src:
                    for r in rows.itertuples(index=False):
                        data, reason = None, None
                        if r.codec not in (8, 32946):
                            reason = f"codec {r.codec}"
                        else:
                            try:
                                src.seek(int(r.offset))
                                data = zlib.decompress(src.read(int(r.length)))
                            except (zlib.error, OSError) as e:
                                reason = type(e).__name__
                        px.append(data)
                        why.append(reason)
            order = pd.concat([rows for _, rows in f.groupby("path", sort=False)])
            yield pd.DataFrame({"path": order["path"].to_numpy(), "idx": order["idx"].to_numpy(), "px": px, "reason": why})

    d = directory.select(F.col(path).alias("path"), F.col("idx").cast("long").alias("idx"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.col("codec").cast("int").alias("codec"))
    d = d.repartition(tasks, "path") if tasks else d
    return d.sortWithinPartitions("path", "offset").mapInPandas(go, "path string, idx long, px binary, reason string")


def tile_pixels(tiles: DataFrame, width: int, samples: int) -> DataFrame:
    """Pixels of inflated tiles (path, idx, px): path, idx, x, y, and the first four samples as q0 to q3 (null beyond ``samples``)."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for f in frames:
            for r in f.itertuples(index=False):
                a = np.frombuffer(r.px, np.uint8).reshape(-1, samples)
                n = np.arange(len(a))
                out = {"path": r.path, "idx": r.idx, "x": n % width, "y": n // width}
                for i in range(4):
                    out[f"q{i}"] = a[:, i].astype("int32") if i < samples else pd.array([None] * len(a), "Int32")
                yield pd.DataFrame(out)

    return tiles.filter("px is not null").select("path", "idx", "px").mapInPandas(go, "path string, idx long, x int, y int, q0 int, q1 int, q2 int, q3 int")


def write_images(pixels: DataFrame, out: str) -> None:
    """Grey images (image, x, y, q from 0 to 255) as PNG files ``out``/<image>.png, a task's images one after the other; pixels that are not given
    are black. A task holds one image at a time, as columns of numbers. ``out`` is a URI that Arrow opens."""

    def save(t: pa.Table) -> pa.Table:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(out if "://" in out else "file://" + out.removeprefix("file:"))
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        x, y, q = (t.column(c).to_numpy() for c in ("x", "y", "q"))
        grid = np.zeros((y.max() + 1, x.max() + 2), np.uint8)  # the first column says: no filter
        grid[y, x + 1] = q
        head = struct.pack(">IIBBBBB", grid.shape[1] - 1, grid.shape[0], 8, 0, 0, 0, 0)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{t.column('image')[0].as_py()}.png") as file:
            file.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(grid.tobytes())) + part(b"IEND", b""))
        return pa.table({"n": pa.array([1], pa.int64())})

    whole = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("q").cast("int").alias("q"))
    whole.groupBy("image").applyInArrow(save, "n long").agg(F.sum("n")).collect()


def refused_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder that do not decode as images: image, reason."""
    im = spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", "image.width")
    return im.filter("width < 0").select(F.col("origin").alias("image"), F.lit("not an image").alias("reason"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as grey pixels 0..1: image, x, y, v, the mean of the colour channels; files that do not decode are left to
    ``refused_images``."""
    im = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("image"), "image.width", "image.nChannels", "image.data")
    n = F.least("nChannels", F.lit(3))
    colours = F.expr("aggregate(sequence(1, least(nChannels, 3)), 0L, (a, c) -> a + conv(hex(substring(data, _i * nChannels + c, 1)), 16, 10))")
    px = im.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.length("data") / F.col("nChannels")).cast("int") - 1)))
    return px.select("image", (F.col("_i") % F.col("width")).alias("x"), F.expr("_i div width").cast("int").alias("y"), (colours / n / 255.0).alias("v"))
