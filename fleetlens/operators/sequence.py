"""Ordered computation: runs, gaps, running totals over all rows, recurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_run(samples: DataFrame, key: str, seq: str, hot: Column, gap: int) -> DataFrame:
    """Labels samples pre / loaded / post by the longest stretch of hot ones in which at most ``gap`` cold ones stand between two; the
    first of equals wins and a single sample is no stretch. Series without a stretch have a null phase."""
    w = Window.partitionBy(key).orderBy(seq)
    cut = F.when(F.col(seq) - F.lag(seq).over(w) > gap + 1, 1).otherwise(0)
    h = samples.filter(hot).select(key, seq, cut.alias("_cut")).withColumn("_run", F.sum("_cut").over(w))
    runs = h.groupBy(key, "_run").agg(F.min(seq).alias("_a"), F.max(seq).alias("_b")).filter("_b > _a")
    best = runs.groupBy(key).agg(F.max(F.struct((F.col("_b") - F.col("_a")).alias("n"), (-F.col("_a")).alias("a"), F.col("_b").alias("b"))).alias("_m"))
    phase = F.when(F.col("_m").isNull(), None).when(F.col(seq) < -F.col("_m.a"), "pre").when(F.col(seq) <= F.col("_m.b"), "loaded").otherwise("post")
    return samples.join(best, key, "left").withColumn("phase", phase).drop("_m")


def running_total(rows: DataFrame, order: list[str], value: str, out: str, parts: int) -> DataFrame:
    """``rows`` with the running sum of ``value`` over all of them in the given order, without gathering them in one task.

    Rows are range-partitioned and summed inside their partition; the sums of the partitions before are added by a join on the
    partition's number, whose table has ``parts`` rows."""
    dealt = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    inner = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    local = dealt.withColumn("_in", inner)
    sums = dealt.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    offset = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    return local.join(offset, "_p").withColumn(out, F.col("_in") + F.col("_o")).drop("_p", "_in", "_o")


def crossings(rows: DataFrame, order: list[str], value: str, step: int, parts: int) -> DataFrame:
    """Rows whose value carries the running total past a multiple of ``step``, a row for each multiple passed (n)."""
    total = running_total(rows, order, value, "total", parts)
    first, last = F.floor((F.col("total") - F.col(value)) / step) + 1, F.floor(F.col("total") / step)
    return total.filter(last >= first).withColumn("n", F.explode(F.sequence(first, last)))


def tile_end_times(passes: DataFrame, key: str, order: str, ms: str, end: str) -> DataFrame:
    """Each pass's end: the render's end less its total plus the running sum of its passes."""
    w = Window.partitionBy(key)
    run = F.sum(ms).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return passes.withColumn("end_at", F.col(end) - F.sum(ms).over(w) + run)


def wait_windows(passes: DataFrame, key: str, order: str, finish: str, dwell: str, workers: int) -> DataFrame:
    """From a worker's pass before (finish + dwell) to this finish, for consecutive passes beyond the first ``workers``; kept where the
    wait is over three medians of the key's."""
    w = Window.partitionBy(key).orderBy(order)
    rows = passes.withColumns({"t0": F.lag(F.col(finish) + F.col(dwell)).over(w), "_before": F.lag(order).over(w), "t1": F.col(finish)})
    rows = rows.filter((F.col("_before") == F.col(order) - 1) & (F.col(order) > workers)).withColumn("wait", F.col("t1") - F.col("t0"))
    med = rows.groupBy(key).agg(F.median("wait").alias("_m"))
    return rows.join(med, key).filter(F.col("wait") > 3 * F.col("_m")).drop("_m", "_before")


def warm_up(busy: DataFrame, key: str, workers: int, tick: int) -> DataFrame:
    """Samples before the first at full width and the idle worker-time in them; all samples where full width is never reached."""
    full = F.min(F.when(F.col("b") >= workers, F.col("seq"))).over(Window.partitionBy(key))
    early = F.col("_full").isNull() | (F.col("seq") < F.col("_full"))
    return busy.withColumn("_full", full).groupBy(key).agg(F.count_if(early).alias("samples"), F.coalesce(F.sum(F.when(early, (workers - F.col("b")) * tick)), F.lit(0)).alias("idle"))


def trace_coverage(trace: DataFrame, key: str, seq: str, total: DataFrame) -> DataFrame:
    """Rows kept of a trace, first, last, mean stride, and whether they describe only a window (under 90 %) of ``total`` (key, n)."""
    g = trace.groupBy(key).agg(F.count("*").alias("rows"), F.min(seq).alias("first"), F.max(seq).alias("last"))
    span = F.col("last") - F.col("first")
    return g.join(total, key).select(key, "rows", "first", "last", F.when(F.col("rows") > 1, span / (F.col("rows") - 1)).alias("stride"), ((span + 1) / F.col("n") < 0.9).alias("window_only"))


def intervals(events: DataFrame, key: str, kind: str, t: str, most: int, kinds: list[str], least: int = 3) -> DataFrame:
    """Gaps (under ``most``) between the events of the finest kind of a key: the first of ``kinds`` with more than ``least`` events.
    Median, 95th percentile, largest and smallest non-zero."""
    counts = events.groupBy(key, kind).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    pick = counts.filter(rank > 0).groupBy(key).agg(F.min_by(kind, rank).alias(kind))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    rows = events.join(pick, [key, kind]).withColumn("gap", gap).filter(F.col("gap") < most)
    return rows.groupBy(key, kind).agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("p50"), F.percentile("gap", 0.95).alias("p95"), F.max("gap").alias("most"), F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("step"))


def kinematics(points: DataFrame, key: str, t: str, half: float, slow: float, limit: float = 300.0) -> DataFrame:
    """Speed from the first and last point within ``half`` of each (x, y over t), heading held while slower than ``slow``, curvature
    (turn over distance) cut at +-``limit`` and smoothed over five points. Times are made non-decreasing by a running maximum."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = points.withColumn("tm", F.max(t).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    frame = f"over (partition by {key} order by tm range between {float(half)}D preceding and {float(half)}D following)"
    lo, hi = (F.expr(f"{f}(struct(tm, seq, x, y)) {frame}") for f in ("min", "max"))
    rows = rows.withColumns({"_lo": lo, "_hi": hi})
    dt = F.col("_hi.tm") - F.col("_lo.tm")
    rows = rows.withColumns({"vx": F.when(dt > 0, (F.col("_hi.x") - F.col("_lo.x")) / dt), "vy": F.when(dt > 0, (F.col("_hi.y") - F.col("_lo.y")) / dt)})
    rows = rows.withColumn("speed", F.hypot("vx", "vy"))
    rows = rows.withColumn("heading", F.last(F.when(F.col("speed") >= slow, F.atan2("vy", "vx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.col("heading") - F.lag("heading").over(w)
    turn = F.atan2(F.sin(turn), F.cos(turn))
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = rows.withColumn("_c", F.when((far > 0) & turn.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), turn / far))))
    return rows.withColumn("curvature", F.avg("_c").over(w.rowsBetween(-2, 2))).drop("_lo", "_hi", "_c")


def dwell(points: DataFrame, key: str, slow: float, decay: float = 0.85) -> DataFrame:
    """Leaky accumulator per point: + dt while v is below ``slow``, else times ``decay``. ``points`` has key, seq, v, dt; a null v counts
    as fast. Keys are dealt over tasks and each task walks its points in order once, holding one number, however long a stroke is."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d, begun = None, 0.0, False
        for b in batches:
            out = []
            for k, v, dt in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not begun or k != now:
                    now, d, begun = k, 0.0, True
                d = d + dt if v is not None and v < slow else d * decay
                out.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=[key, "seq", "dwell"])

    rows = points.select(key, F.col("seq").cast("long").alias("seq"), F.col("v").cast("double").alias("v"), F.coalesce(F.col("dt").cast("double"), F.lit(0.0)).alias("dt"))
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(walk, f"{key} {dict(points.dtypes)[key]}, seq long, dwell double")


def thin_series(rows: DataFrame, key: str, seq: str, cap: int, run: int = 1) -> DataFrame:
    """Every 2 ** k-th run of ``run`` samples, run 0 included, with the smallest k that leaves at most ``cap`` samples of a full grid."""
    n = (F.max(seq).over(Window.partitionBy(key)) + 1).cast("double")
    stride = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(n / cap)).cast("double"))).cast("long")
    return rows.withColumn("stride", stride).filter(F.pmod(F.floor(F.col(seq) / run), F.col("stride")) == 0)


def keep_best_copy(rows: DataFrame, key: list[str], priority: str, size: str, name: str) -> DataFrame:
    """Per key the copy to keep (priority first, then the largest, then the least name), reclaimable size of the rest, and whether sizes
    differ."""
    w = Window.partitionBy(*key).orderBy(F.desc(priority), F.desc(size), name)
    g = rows.withColumn("_r", F.row_number().over(w)).groupBy(*key).agg(F.count("*").alias("copies"), F.max(F.when(F.col("_r") == 1, F.col(name))).alias("kept"), F.coalesce(F.sum(F.when(F.col("_r") > 1, F.col(size))), F.lit(0)).alias("reclaimable"), (F.min(size) != F.max(size)).alias("sizes_differ"))
    return g


def session_position(rows: DataFrame, session: str, order: list[str]) -> DataFrame:
    """The number of each row in its session, from 1."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))


def chronology(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Place of each row in its group's time order and size of the group."""
    w = Window.partitionBy(group)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)).cast("long"), "group_size": F.count("*").over(w)})


def slow_gaps(passes: DataFrame, key: str, order: str, ms: str, over: float = 2.0) -> DataFrame:
    """Gaps between successive slow passes (over ``over`` medians) per key: slow passes, most frequent gap (the least of equals), its share."""
    med = passes.groupBy(key).agg(F.median(ms).alias("_m"))
    slow = passes.join(med, key).filter(F.col(ms) > over * F.col("_m"))
    gap = slow.withColumn("gap", F.col(order) - F.lag(order).over(Window.partitionBy(key).orderBy(order))).filter("gap is not null")
    g = gap.groupBy(key, "gap").agg(F.count("*").alias("_n"))
    return g.groupBy(key).agg(F.sum("_n").alias("gaps"), F.max_by("gap", F.struct("_n", -F.col("gap"))).alias("period"), (F.max("_n") / F.sum("_n")).alias("share"))


