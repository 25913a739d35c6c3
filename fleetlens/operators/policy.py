"""Merging, verifying, reconciling and deciding over tables of renders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import opened, replaced
from .joins import samples_in_windows


def upsert(batch: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """The target with the batch merged by key: the latest row by ``order`` wins, the batch among equals. Write the result beside the
    target and swap; no row of the target is lost before that."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_b"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_b")


def name_collisions(rows: DataFrame, name: str, body: str) -> DataFrame:
    """Names under which more than one body would be written."""
    return rows.groupBy(name).agg(F.count_distinct(F.xxhash64(body)).alias("bodies"), F.count("*").alias("rows")).filter("bodies > 1")


def write_sidecars(rows: DataFrame, path: str, name: str, body: str) -> None:
    """Writes (name, body) rows once they are free of collisions, reads them back and compares; raises otherwise."""
    if not name_collisions(rows, name, body).isEmpty():
        raise ValueError("two bodies under one name")
    rows = rows.dropDuplicates([name])
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if not tables_differ(rows, back).isEmpty():
        raise RuntimeError("what was written does not read back")


def export_stats_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in the given order as CSV with a header; missing ones are empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def split_log_by_render(log: DataFrame, windows: DataFrame, path: str, render: str, t: str = "t", lo: str = "t0", hi: str = "t1", by: tuple[str, ...] = ()) -> None:
    """One folder of CSV for each window (render, lo, hi), with the rows of the log whose time lies in it, both ends included, in order of time and
    with the log's own columns. A row in several windows is in each of their folders. Rows of a window go to as few files as tasks hold it.

    Where Arrow opens ``path``, tasks write the files by it, as Spark's writer takes some 25 ms for a folder on a local disk: lines, names of
    folders and the header are as that writer has them, a file is moved to its place once it is whole, and the folders take the place of ``path`` together."""
    hits = samples_in_windows(log, windows.select(render, *by, lo, hi), t, lo, hi, by).select(render, *log.columns)
    dealt = hits.repartitionByRange(render, t).sortWithinPartitions(render, t)
    spark = log.sparkSession
    place = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    scheme, at = opened(spark, place)
    if scheme is None:
        dealt.write.mode("overwrite").partitionBy(render).csv(path, header=True)
        return
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in log.columns]))).first()[0]
    lines = dealt.select(F.nullif(F.col(render).cast("string"), F.lit("")).alias("name"), F.to_csv(F.struct(*[F.col(c) for c in log.columns])).alias("line"))
    lines.mapInArrow(_csv_folders(scheme, at, render, header), "n long").agg(F.sum("n")).first()
    replaced(spark, place, path)


def _folder(column: str, value: str | None) -> str:
    """The name that Spark gives the folder of a partition."""
    escape = lambda text: re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", text)
    return f"{escape(column)}={escape(value) if value else '__HIVE_DEFAULT_PARTITION__'}"


def _csv_folders(scheme: str, at: str, column: str, header: str):  # noqa: ANN202
    """For mapInArrow: rows (name, line) in order of name to a file in the folder of each name, one file open at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs = pafs.LocalFileSystem() if scheme.startswith("file:") else pafs.FileSystem.from_uri(scheme)[0]
        task = TaskContext.get()
        draft = f"{at}/_temporary/{task.taskAttemptId()}.csv"
        fs.create_dir(f"{at}/_temporary", recursive=True)
        file, now, n = None, None, 0

        def close() -> None:
            file.close()
            folder = f"{at}/{_folder(column, now)}"
            fs.create_dir(folder, recursive=True)
            own = f"{folder}/part-{task.partitionId():05d}.csv"
            if fs.get_file_info(own).type != pafs.FileType.NotFound:
                fs.delete_file(own)  # of an attempt before
            fs.move(draft, own)

        for b in batches:
            for name, rows in groupby(zip(*(c.to_pylist() for c in b.columns), strict=True), lambda r: r[0]):
                if file is None or name != now:
                    if file is not None:
                        close()
                    file, now = fs.open_output_stream(draft), name
                    file.write(f"{header}\n".encode())
                file.write("".join(f"{line}\n" for _, line in rows).encode())
            n += b.num_rows
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def tables_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; as often as they are missing on the other."""
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    odd = signed.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return odd.withColumn("side", F.when(F.col("_n") > 0, "a").otherwise("b")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.abs(F.col("_n"))))).drop("_n")


def union_sources(first: DataFrame, *more: DataFrame, key: str) -> DataFrame:
    """The first source, then of each further one the rows whose key is not there yet."""
    out = first
    for m in more:
        out = out.unionByName(m.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def size_twins(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups of equal keys with more than one row: members and the least and greatest name."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).filter("n > 1")


def extract_figures(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """The figure that a pattern finds in each text: null with a reason where it finds none or several."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return docs.select(key, F.size(found).alias("matches"), F.when(F.size(found) == 1, found[0]).alias("figure"))


def reconcile_published(figures: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Published figures (key, matches, figure) against fresh facts (key, fact), as strings: exactly one match that equals, or why not."""
    j = figures.join(facts, key)
    return j.select(key, "figure", "fact", F.when(F.col("matches") == 0, "not found").when(F.col("matches") > 1, "found twice").when(F.col("figure") == F.col("fact"), "ok").otherwise("differs").alias("status"))


def verify_sidecars(rows: DataFrame, passes: DataFrame, key: str) -> DataFrame:
    """Reason why a record is refused: no width, no time, no passes, or another number of passes than recorded; null if none."""
    n = passes.groupBy("render").agg(F.count("*").alias("_n"))
    j = rows.join(n, F.col(key) == F.col("render"), "left")
    why = F.when(F.col("w").isNull(), "no width").when(F.col("at_s").isNull(), "no time").when(F.col("_n").isNull(), "no passes").when(F.col("_n") != F.col("recorded"), "passes")
    return j.select(key, why.alias("reason"))


def census_self_check(rows: DataFrame, cut: Column, published_n: int, published_px: int, pixels: str) -> DataFrame:
    """Count and pixels up to a cut beside the published ones, and whether both agree; current figures are for trust only then."""
    g = rows.filter(cut).agg(F.count("*").alias("n"), F.sum(F.col(pixels).cast("decimal(38,0)")).cast("long").alias("pixels"))
    return g.withColumn("trusted", (F.col("n") == published_n) & (F.col("pixels") == published_px))


def retention_plan(rows: DataFrame, size: str, hours: str, keep: Column, refused: Column, group: str, top: int, release: DataFrame | None = None) -> DataFrame:
    """What happens to each file: refused, kept, hold (two hours or more to remake, or among the ``top`` largest), else sweep; notes say what
    is special (the only one of its group). A release token (file) lets a held file go."""
    w = Window.partitionBy(group)
    big = rows.select("file", size).orderBy(F.desc(size), "file").limit(top).select("file", F.lit(True).alias("_big"))
    j = rows.withColumn("_only", F.count("*").over(w) == 1).join(F.broadcast(big), "file", "left")  # at most ``top`` rows
    if release is None:
        j = j.withColumn("_free", F.lit(False))
    else:
        j = j.join(release.select("file", F.lit(True).alias("_free")).distinct(), "file", "left")
    reasons = F.array_compact(F.array(F.when(F.col(hours) >= 2, F.lit("dear")), F.when(F.col("_big"), F.lit("largest"))))
    action = F.when(refused, "refused").when(keep, "kept").when((F.size(reasons) > 0) & ~F.coalesce("_free", F.lit(False)), "hold").otherwise("sweep")
    return j.select("file", action.alias("action"), F.concat_ws(",", reasons).alias("reasons"), F.when(F.col("_only"), "only one of its group").alias("note"))


def unmatched_tokens(release: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return release.join(rows.select(key).distinct(), key, "left_anti")


def inventory_report(rows: DataFrame, status: str, name: str) -> DataFrame:
    """Rows, first and last name of each status."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last"))
