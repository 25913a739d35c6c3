"""Hardware logs: samples of sensors over time, idle floors, phases and drift.

A share or mean over no rows is null; refusals are a column, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_rank, ratio


def utilisation(busy: DataFrame, key: str, workers: int, tick: int) -> DataFrame:
    """Mean busy workers, percent of all and idle worker-time of each series of busy counts (b)."""
    return busy.groupBy(key).agg(F.avg("b").alias("mean_busy"), (100 * F.avg("b") / workers).alias("percent"), F.sum((workers - F.col("b")) * tick).alias("idle"))


def busy_histogram(busy: DataFrame, key: str, workers: int) -> DataFrame:
    """Samples and their share per busy count, counts above ``workers`` being capped."""
    g = busy.groupBy(key, F.least("b", F.lit(workers).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def vote_offset(rows: DataFrame) -> DataFrame:
    """The most frequent whole-hour offset of ``utc`` over ``local`` (seconds), the lower of equals, with its votes and all votes."""
    g = rows.select(F.round((F.col("utc") - F.col("local")) / 3600).cast("long").alias("hours")).filter("hours is not null").groupBy("hours").agg(F.count("*").alias("agree"))
    return g.agg(F.max_by("hours", F.struct("agree", -F.col("hours"))).alias("hours"), F.max("agree").alias("agree"), F.sum("agree").alias("total"))


def idle_floor(samples: DataFrame, key: str, value: str, least: int = 300, most_floor: float = 4, most_over: float = 1) -> DataFrame:
    """Quiet decile and median by nearest rank, mean, share above the decile + 1, and why the floor is refused (too few samples, a floor
    too high, a mean too far above it)."""
    p10 = exact_rank(samples, [key], value, 0.1, "nearest").withColumnRenamed(value, "p10")
    p50 = exact_rank(samples, [key], value, 0.5, "nearest").withColumnRenamed(value, "p50")
    g = samples.join(p10, key).groupBy(key).agg(F.count(value).alias("n"), F.first("p10").alias("p10"), F.avg(value).alias("mean"), F.avg((F.col(value) > F.col("p10") + 1).cast("double")).alias("above"))
    why = F.when(F.col("n") <= least, "too few").when(F.col("p10") > most_floor, "floor too high").when(F.col("mean") > F.col("p10") + most_over, "not idle")
    return g.join(p50, key).withColumn("refused", why)


def render_hardware(hits: DataFrame, key: str, sensor: str, value: str, sensors: list[str], load: str, floor: float, workers: int) -> DataFrame:
    """Mean of each sensor over the samples of a render, and its load above the idle floor per worker."""
    g = hits.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(F.when(F.col(sensor) == s, F.col(value))).alias(s) for s in sensors])
    return g.withColumn("above_floor", (F.col(load) - floor) / workers)


def foreign_io(hits: DataFrame, key: str, t: str, rate: str, size: str, trip: float, slack: float = 1.15) -> DataFrame:
    """The integral of a write rate over a render against its own size, and the samples over ``trip``: number, first, last."""
    dt = (F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))) / 1e6
    over = F.col(rate) > trip
    g = hits.withColumn("_dt", dt).groupBy(key).agg(F.first(size).alias("_size"), F.sum(F.col(rate) * F.col("_dt")).alias("written"), F.count_if(over).alias("over_n"), F.min(F.when(over, F.col(t))).alias("over_first"), F.max(F.when(over, F.col(t))).alias("over_last"))
    return g.select(key, "written", (F.col("written") > F.col("_size") * slack).alias("is_foreign"), "over_n", "over_first", "over_last")


def phase_means(labelled: DataFrame, key: str, phase: str, value: str) -> DataFrame:
    """Mean and peak of a sensor before, in and after the loaded stretch."""
    aggs = [a for p in ("pre", "loaded", "post") for a in (F.avg(F.when(F.col(phase) == p, F.col(value))).alias(f"{p}_mean"), F.max(F.when(F.col(phase) == p, F.col(value))).alias(f"{p}_peak"))]
    return labelled.groupBy(key).agg(*aggs)


def throttle_flags(rows: DataFrame, key: str, flag: str, value: str, limit: float) -> DataFrame:
    """How often a flag says yes, and the share of samples at 95 % of a limit or more."""
    return rows.groupBy(key).agg(F.count_if(F.col(flag).rlike("(?i)^(yes|y|r)$")).alias("yes"), F.avg((F.col(value) >= 0.95 * limit).cast("double")).alias("at_limit"))


def drift_thirds(samples: DataFrame, key: str, order: str, value: str, least: int = 9) -> DataFrame:
    """Mean of the first and last third (floor(n / 3) rows each) and the flag of the change; null below ``least`` rows."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    third = F.floor(F.col("_n") / 3)
    g = samples.withColumns({"_i": i, "_n": n}).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_i") <= third, F.col(value))).alias("a"), F.avg(F.when(F.col("_i") > F.col("_n") - third, F.col(value))).alias("b"))
    change = F.when(F.col("n") >= least, ratio(F.col("b"), F.col("a")) - 1)
    return g.select(key, "n", F.col("a").alias("first_third"), F.col("b").alias("last_third"), change.alias("change"), F.when(change > 0.03, "rising").when(change < -0.1, "falling").when(change.isNotNull(), "steady").alias("drift"))


def sibling_ratio(rows: DataFrame, key: str, thread: str, value: str) -> DataFrame:
    """Mean use of second threads over that of first threads, per core; null where a core has only one."""
    g = rows.groupBy(key).agg(F.avg(F.when(F.col(thread) == 0, F.col(value))).alias("t0"), F.avg(F.when(F.col(thread) == 1, F.col(value))).alias("t1"))
    return g.withColumn("sibling", ratio(F.col("t1"), F.col("t0")))


def burst_profile(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median and 95th percentile by index floor(n * q), peak, and the verdict on it."""
    p50 = exact_rank(samples, [key], value, 0.5, "upper").withColumnRenamed(value, "p50")
    p95 = exact_rank(samples, [key], value, 0.95, "upper").withColumnRenamed(value, "p95")
    g = samples.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("peak")).join(p50, key).join(p95, key)
    return g.withColumn("verdict", burst_verdict(F.col("p50"), F.col("p95"), F.col("peak")))


def burst_verdict(p50: Column, p95: Column, peak: Column) -> Column:
    """saturated: the median is at 95 % of the peak; bursty: the 95th percentile is three medians or more; headroom else."""
    return F.when(p50 >= 0.95 * peak, "saturated").when(p95 >= 3 * p50, "bursty").when(peak.isNotNull(), "headroom")


def drive_profile(samples: DataFrame, key: str, t: str, rate: str) -> DataFrame:
    """Mean, exact 95th percentile, peak and integral of a rate, and whether the peak is over five means."""
    dt = (F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))) / 1e6
    g = samples.withColumn("_dt", dt).groupBy(key).agg(F.avg(rate).alias("mean"), F.percentile(rate, 0.95).alias("p95"), F.max(rate).alias("peak"), F.sum(F.col(rate) * F.col("_dt")).alias("total"))
    return g.withColumn("peaky", F.col("peak") > 5 * F.col("mean"))


def slow_vs_rest(tiles: DataFrame, key: str, rank: str, n: int, state: str) -> DataFrame:
    """Mean machine state at the n slowest tiles of a render and at all others, and whether they differ by more than 25 %."""
    slow = F.col(rank) <= n
    g = tiles.groupBy(key).agg(F.avg(F.when(slow, F.col(state))).alias("slow_mean"), F.avg(F.when(~slow, F.col(state))).alias("rest_mean"))
    return g.withColumn("differs", F.abs(ratio(F.col("slow_mean"), F.col("rest_mean")) - 1) > 0.25)


def session_drift(rows: DataFrame, session: str, order: str, ms: str) -> DataFrame:
    """Second over first, last over best, and whether the first and last runs of a session differ by more than 5 %."""
    w = Window.partitionBy(session).orderBy(order)
    g = rows.withColumn("_i", F.row_number().over(w)).groupBy(session).agg(F.count("*").alias("runs"), F.min_by(ms, order).alias("_first"), F.max(F.when(F.col("_i") == 2, F.col(ms))).alias("_second"), F.max_by(ms, order).alias("_last"), F.min(ms).alias("_best"))
    return g.select(session, "runs", ratio(F.col("_second"), F.col("_first")).alias("second_first"), ratio(F.col("_last"), F.col("_best")).alias("last_best"), (F.abs(ratio(F.col("_last"), F.col("_first")) - 1) > 0.05).alias("untrusted"))


def interleaved_medians(runs: DataFrame, session: str, variant: str, order: str, ms: str) -> DataFrame:
    """Upper median per session and variant with the session's trust flag."""
    med = exact_rank(runs, [session, variant], ms, 0.5, "upper").withColumnRenamed(ms, "median")
    return med.join(session_drift(runs, session, order, ms).select(session, "untrusted"), session)


def core_seconds(rows: DataFrame, wall: str, busy: str, base_wall: float, base_busy: float) -> DataFrame:
    """wall x busy threads, and what made a render slower than the base: work (core time), schedule (fewer threads) or machine."""
    core = F.col(wall) * F.col(busy)
    more = core > 1.1 * base_wall * base_busy
    return rows.withColumn("core_s", core).withColumn("verdict", F.when(F.col(wall) <= 1.1 * base_wall, "as fast").when(more, "work").when(F.col(busy) < 0.9 * base_busy, "schedule").when(core.isNotNull(), "machine"))
