"""Streaming operators, each with a batch twin over the same columns.

State is bounded: every stateful operator drops what the watermark or a time to live has passed. Event times are Spark
timestamps; a time without zone is cast first, with the session zone fixed to UTC.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import exact_rank
from ..sources.files import last_object
from ..sources.snapshots import SnapshotTable
from .state import Harvest, History, Settled, require_state_store


def settled_arrivals(polls: DataFrame, path: str = "path", t: str = "t", size: str = "size") -> DataFrame:
    """Batch: the first poll of each path whose size equals that of the poll before; a path settles once. Null sizes settle nothing."""
    w = Window.partitionBy(path).orderBy(t)
    same = polls.withColumn("_p", F.lag(size).over(w)).filter(F.col("_p") == F.col(size))
    return same.groupBy(path).agg(F.min(t).alias(t), F.min_by(size, t).alias(size))


def settled_arrivals_stream(polls: DataFrame, forget: str = "1 hour") -> DataFrame:
    """Stream of (path string, t timestamp, size long): emits a path when two successive polls agree, then forgets it after ``forget``
    of event time without a poll."""
    require_state_store(polls.sparkSession)
    keep = int(pd.Timedelta(forget).total_seconds() * 1000)
    return polls.withWatermark("t", forget).groupBy("path").transformWithStateInPandas(Settled(keep), "path string, t timestamp, size long", "Append", "EventTime")


def growing_files(first: DataFrame, second: DataFrame, key: str, size: str) -> DataFrame:
    """Two snapshots: growing, settled, new or gone."""
    a, b = first.select(key, F.col(size).alias("_a")), second.select(key, F.col(size).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "growing").otherwise("settled").alias("status"))


def judged(files: DataFrame, key: str, order: str, verdict: Column) -> DataFrame:
    """Each path judged once, at its first sight: verdict and where it goes. Works on streams after ``dropDuplicatesWithinWatermark``."""
    rows = files if files.isStreaming else files.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")
    return rows.withColumn("verdict", verdict).withColumn("goes_to", F.when(F.col("verdict").isNull(), "index").otherwise("aside"))


def harvested(files: DataFrame, marker: str, read: Callable[[str], str | None] | None = None, retry: str = "30 seconds", most: int = 8, forget: str = "7 days") -> DataFrame:
    """Stream of (path string, t timestamp, body string): each path once with the JSON object after the last ``marker`` of its body (meta),
    or null once ``most`` readings have found none. Bodies without it are read again with ``read`` after ``retry``, doubled each time."""
    require_state_store(files.sparkSession)
    ms = lambda d: int(pd.Timedelta(d).total_seconds() * 1000)

    def parse(body: str) -> str | None:
        found = last_object(body, marker)
        return found and found[0]

    step = Harvest(parse, read, ms(retry), most, ms(forget))
    return files.select("path", "t", "body").groupBy("path").transformWithStateInPandas(step, "path string, t timestamp, meta string, tries int", "Append", "ProcessingTime")


def harvest_stream(
    files: DataFrame, marker: str, schema: str, verdict: Column, refusal: Column, index: SnapshotTable, aside: SnapshotTable, name: str, checkpoint: str,
    read: Callable[[str], str | None] | None = None, retry: str = "30 seconds", most: int = 8, forget: str = "7 days", every: str | None = None,
):
    """Parses, judges and records a stream of files (path, t, body), and returns the running query.

    ``schema`` types the fields of the metadata, over which ``verdict`` (why a file is set aside, or null) and ``refusal`` (what a record
    lacks, or null) are columns. Verified rows go to the table ``index``, all others with their ``status`` to ``aside``; both are merged by
    path in snapshot commits that carry the batch's number under ``name``. So a batch that is run again after a crash, between the two commits
    or after both, changes nothing twice. With ``every``, a time between batches, the query runs on and waiting files are read again when
    due; without, it ends once all that is there is taken, and waiting files are read again by a later run's batches."""
    fields = [c for c in T.StructType.fromDDL(schema).names if c not in ("path", "t", "tries")]
    rows = harvested(files, marker, read, retry, most, forget).withColumn("_m", F.from_json("meta", schema))
    rows = rows.select("path", "t", "tries", "meta", *[F.col("_m")[c].alias(c) for c in fields])
    status = F.when(F.col("meta").isNull(), "not parsed").otherwise(F.coalesce(verdict, refusal, F.lit("verified")))
    rows = rows.withColumn("status", status)

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            index.upsert(batch.filter("status = 'verified'"), (name, number))
            aside.upsert(batch.filter("status <> 'verified'"), (name, number))
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    # Wall-clock timers ask for one more batch without end, so a query that is to end runs no batch without data.
    conf, key = files.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return writer.trigger(availableNow=True).start()  # takes a copy of the session's settings
    finally:
        conf.set(key, was)


def unknown_shape_alerts(files: DataFrame, prefixes: DataFrame, key: str, name: str, shape: str, t: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Names of an export's shape with a prefix that is not known: one row per path. ``prefixes`` is static. A stream needs its event time
    ``t``: a path that comes again within ``delay`` of it gives no second alert, and is forgotten after that."""
    own = files.filter(F.col(name).rlike(shape)).withColumn("prefix", F.regexp_extract(name, "^([^-/_.]+)", 1))
    known = prefixes.select(F.col("prefix").alias("_p")).distinct()
    out = own.join(known, F.col("prefix") == F.col("_p"), "left_outer").filter("_p is null").drop("_p")
    if not files.isStreaming:
        return out.dropDuplicates([key])
    if t is None:
        raise ValueError("a stream of files needs its event time")
    return out.withWatermark(t, delay).dropDuplicatesWithinWatermark([key])


def event_rates(events: DataFrame, t: str, kind: str, window: str, slide: str, seconds: float, delay: str | None = None) -> DataFrame:
    """Events a second by kind over sliding windows: start (microseconds), kind, n, per_second. ``delay`` sets the stream's watermark."""
    if delay is not None:
        events = events.withWatermark(t, delay)
    g = events.groupBy(F.window(t, window, slide).alias("_w"), kind).agg(F.count("*").alias("n"))
    return g.select(F.unix_micros("_w.start").alias("start"), kind, "n", (F.col("n") / seconds).alias("per_second"))


def hover_median(events: DataFrame, t: str, hover: str, value: str, window: str = "1500 milliseconds", slide: str = "500 milliseconds", delay: str | None = None) -> DataFrame:
    """The lower median of what hovering events hold over sliding windows: start (microseconds), n, median. Windows without a hovering
    event give no row. A batch is exact at any size, by a sort that spills; a stream, of which ``delay`` sets the watermark, keeps a sketch for
    each window, which is exact up to 10,000 distinct values and at most a ten-thousandth of the ranks off beyond."""
    own = events.filter(F.col(hover) & F.col(value).isNotNull())
    if events.isStreaming:
        g = own.withWatermark(t, delay) if delay is not None else own
        g = g.groupBy(F.window(t, window, slide).alias("_w")).agg(F.count("*").alias("n"), F.percentile_approx(value, 0.5, 10_000).alias("median"))
        return g.select(F.unix_micros("_w.start").alias("start"), "n", "median")
    rows = own.select(F.window(t, window, slide).alias("_w"), F.col(value).alias("median")).select(F.unix_micros("_w.start").alias("start"), "median")
    return rows.groupBy("start").agg(F.count("*").alias("n")).join(exact_rank(rows, ["start"], "median", 0.5, "nearest"), "start")


def bounded_history(events: DataFrame, key: str, t: str, keep: int, most: int) -> DataFrame:
    """Batch: of each key the events of the last ``keep`` units before its latest, at most ``most`` of them, oldest dropped; full says that
    the count did the dropping."""
    w = Window.partitionBy(key)
    r = F.row_number().over(w.orderBy(F.desc(t)))
    recent = events.withColumn("_m", F.max(t).over(w)).filter(F.col(t) >= F.col("_m") - keep).withColumns({"_r": r, "_n": F.count("*").over(w)})
    return recent.filter(F.col("_r") <= most).withColumn("full", F.col("_n") > most).drop("_m", "_r", "_n")


def bounded_history_stream(events: DataFrame, keep: str, most: int, delay: str = "1 minute") -> DataFrame:
    """Stream of (key string, t timestamp, value double): after each batch the size of a key's history cut to ``keep`` and ``most``, and
    whether it is full. The history is the state, in buckets of a 64th of ``keep``; it goes once the watermark (``delay``) is ``keep`` past its
    last event."""
    require_state_store(events.sparkSession)
    step = History(int(pd.Timedelta(keep).total_seconds() * 1_000_000), most)
    return events.withWatermark("t", delay).groupBy("key").transformWithStateInPandas(step, "key string, n long, full boolean", "Update", "EventTime")


def sampler_overruns(samples: DataFrame, key: str, t: str, cost: str, every: float) -> DataFrame:
    """Samples whose cost exceeded the interval, or that came after a gap of more than twice of it."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return samples.withColumn("gap", gap).withColumns({"overran": F.col(cost) > every, "late": F.col("gap") > 2 * every}).filter("overran or late")


def top_processes(rows: DataFrame, key: str, processes: str, n: int) -> DataFrame:
    """Per sample the sum and largest of its processes' memory (array of (mb, pid)) and the n largest; works on streams."""
    top = F.slice(F.sort_array(F.col(processes), asc=False), 1, n)
    return rows.select(key, F.size(processes).alias("procs"), F.aggregate(processes, F.lit(0).cast("long"), lambda a, p: a + p["mb"]).alias("total"), F.array_max(F.transform(processes, lambda p: p["mb"])).alias("biggest"), F.concat_ws(",", F.transform(top, lambda p: F.concat_ws(":", p["mb"], p["pid"]))).alias("top"))
