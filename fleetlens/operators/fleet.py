"""Aggregates over renders and their passes.

Renders have file, inputs, at, engine, ms, w ...; passes have render, pass, ms, bytes. Nulls in a measure do not count, as in SQL
aggregates; an empty table gives no rows for grouped results and one row of nulls or zeros for whole-table ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_rank, pearson, quantiles, ratio, whole_ranks

BIG = "decimal(38,0)"


def resume_stall(renders: DataFrame, passes: DataFrame, over: float = 1.05, under: float = 0.95) -> DataFrame:
    """The sum of a render's passes over its own clock: above ``over`` it resumed, below ``under`` it stalled. off: they differ by
    more than 2 %. Renders without passes are left out; a clock of zero has no ratio and no verdict."""
    sums = passes.groupBy("render").agg(F.sum("ms").alias("honest_ms"))
    r = ratio(F.col("honest_ms"), F.col("ms"))
    return renders.join(sums, renders["file"] == sums["render"]).select(
        "file", "honest_ms", r.alias("ratio"),
        F.when(r > over, "resumed").when(r < under, "stalled").when(r.isNotNull(), "whole").alias("verdict"),
        (F.abs(r - 1) > 0.02).alias("off"),
    )


def fleet_totals(renders: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: renders, bytes, largest, and the bytes of the texts with CRLF counted as LF; bytes per text byte."""
    a = renders.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.sum(F.col("pixels").cast(BIG)).cast("long").alias("pixels"))
    b = texts.agg(F.sum(F.octet_length(F.replace("text", F.lit("\r\n"), F.lit("\n")))).alias("text_bytes"))
    return a.crossJoin(b).withColumn("bytes_per_text_byte", ratio(F.col("bytes"), F.col("text_bytes")))  # two single rows


def hardware_classes(index: DataFrame, keys: list[str], width: str, tile: str) -> DataFrame:
    """Rows, largest width and the sorted set of tiles for each class of hardware; rows whose first key is null are skipped."""
    return index.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.max(width).alias("widest"), F.concat_ws(",", F.array_sort(F.collect_set(F.col(tile).cast("string")))).alias("tiles"))


def render_census(rows: DataFrame, keys: list[str], pixels: str, black: Column, goal: int = 1 << 40) -> DataFrame:
    """Distinct renders by key with black frames out, totals per engine and over all (engine null), with the share of the goal."""
    own = rows.filter(~F.coalesce(black, F.lit(False))).dropDuplicates(keys)
    total = F.sum(F.col(pixels).cast(BIG))
    return own.groupingSets([["engine"], []], "engine").agg(F.count("*").alias("n"), total.cast("long").alias("pixels"), (total.cast("double") / goal).alias("share"))


def footprint(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Files and bytes by key, with a TOTAL row."""
    out = rows.rollup(key).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.grouping(key).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "files", "bytes")


def singletons(rows: DataFrame, *keys: list[str]) -> DataFrame:
    """Flags of members that are the only one of their key, one flag for each list of keys."""
    for i, k in enumerate(keys):
        rows = rows.withColumn(f"only_{i}", F.count("*").over(Window.partitionBy(*k)) == 1)
    return rows


def tile_stats(passes: DataFrame) -> DataFrame:
    """Passes, least, most, upper and midpoint median of ms, and how many took over twice the upper median."""
    upper = exact_rank(passes, ["render"], "ms", 0.5, "upper").withColumnRenamed("ms", "upper_median")
    mid = quantiles(passes, ["render"], {"mid_median": ("ms", 0.5)})
    return passes.join(upper, "render").groupBy("render").agg(
        F.count("ms").alias("n"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.first("upper_median").alias("upper_median"),
        F.count_if(F.col("ms") > 2 * F.col("upper_median")).alias("slow"),
    ).join(mid, "render")


def slow_tile_carry(passes: DataFrame, over: float = 2.0) -> DataFrame:
    """Of passes over ``over`` medians: time ratio, byte ratio and carry = (byte ratio - 1) / (time ratio - 1)."""
    med = passes.groupBy("render").agg(F.median("ms").alias("m"), F.median("bytes").alias("b"))
    slow = passes.join(med, "render").filter(F.col("ms") > over * F.col("m"))
    g = slow.groupBy("render").agg(F.count("*").alias("slow"), F.median("ms").alias("sm"), F.median("bytes").alias("sb"), F.first("m").alias("m"), F.first("b").alias("b"))
    t, b = ratio(F.col("sm"), F.col("m")), ratio(F.col("sb"), F.col("b"))
    return g.select("render", "slow", t.alias("time_ratio"), b.alias("byte_ratio"), ratio(b - 1, t - 1).alias("carry"))


def time_bytes_corr(passes: DataFrame) -> DataFrame:
    """Pearson r of ms and bytes for each render, null where either does not vary."""
    return passes.groupBy("render").agg(F.count("*").alias("n"), pearson("ms", "bytes").alias("r"))


def cost_split(passes: DataFrame, key: str = "render") -> DataFrame:
    """Least squares ms = a + b * bytes: slope, intercept, r2, ms per byte and the share of the fixed part."""
    g = passes.groupBy(key).agg(F.regr_slope("ms", "bytes").alias("slope"), F.regr_intercept("ms", "bytes").alias("intercept"), F.regr_r2("ms", "bytes").alias("r2"), F.sum("ms").alias("ms"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return g.select(key, "n", "slope", "intercept", "r2", ratio(F.col("ms"), F.col("bytes")).alias("per_byte"), ratio(F.col("intercept") * F.col("n"), F.col("ms")).alias("fixed_share"))


def cost_ranking(fits: DataFrame, key: str, cost: str, fixed: str, tile: str) -> DataFrame:
    """Rank by whole cost, spread of the dearest over the cheapest, and a warning where tile sizes differ. ``fits`` is one row per
    group of renders: a report, not a fact table."""
    ends = fits.agg(F.max(cost).alias("hi"), F.min(cost).alias("lo"), F.count_distinct(tile).alias("tiles"))
    ranked = fits.withColumn("rank", F.rank().over(Window.orderBy(F.desc(cost))))
    return ranked.crossJoin(ends).select(key, "rank", cost, fixed, (ratio(F.col("hi"), F.col("lo")) - 1).alias("spread"), (F.col("tiles") > 1).alias("mixed_tiles"))


def spread_at_width(rows: DataFrame, width: str, picture: str, *measures: str) -> DataFrame:
    """Least, most and their ratio of each measure per width that more than one picture has."""
    aggs = [F.count_distinct(picture).alias("pictures")]
    for m in measures:
        aggs += [F.min(m).alias(f"{m}_least"), F.max(m).alias(f"{m}_most"), ratio(F.max(m), F.min(m)).alias(f"{m}_spread")]
    return rows.groupBy(width).agg(*aggs).filter("pictures > 1")


def bpp_ladder(rows: DataFrame, picture: str, width: str, value: str, order: str) -> DataFrame:
    """First row of each width per picture, in order of width: rungs, direction and largest over least."""
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(picture, width).orderBy(order))).filter("_r = 1")
    step = F.col(value) - F.lag(value).over(Window.partitionBy(picture).orderBy(width))
    g = one.withColumn("_s", step).groupBy(picture).agg(F.count("*").alias("rungs"), F.count_if(F.col("_s") > 0).alias("up"), F.count_if(F.col("_s") < 0).alias("down"), ratio(F.max(value), F.min(value)).alias("spread"))
    return g.select(picture, "rungs", F.when((F.col("up") == 0) & (F.col("down") > 0), "falling").when((F.col("down") == 0) & (F.col("up") > 0), "rising").when((F.col("up") == 0) & (F.col("down") == 0), "flat").otherwise("mixed").alias("direction"), "spread")


def power_law(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """ln y = c + e * ln x per key: exponent, the ratio a doubling gives, mean, deviation and relative spread of neighbouring ratios."""
    step = ratio(F.col(y), F.lag(y).over(Window.partitionBy(key).orderBy(x)))
    g = rows.filter((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_s", step).groupBy(key).agg(
        F.regr_slope(F.log(y), F.log(x)).alias("exponent"), F.avg("_s").alias("mean_ratio"), F.stddev_samp("_s").alias("sd_ratio")
    )
    return g.select(key, "exponent", F.pow(F.lit(2.0), F.col("exponent")).alias("per_doubling"), "mean_ratio", "sd_ratio", ratio(F.col("sd_ratio"), F.col("mean_ratio")).alias("relative_spread"))


def saturated_share(passes: DataFrame, value: str, over: float) -> DataFrame:
    """Share of a render's passes above ``over`` and share at the render's least value."""
    low = F.min(value).over(Window.partitionBy("render"))
    return passes.withColumn("_low", low).groupBy("render").agg(F.avg((F.col(value) > over).cast("double")).alias("saturated"), F.avg((F.col(value) == F.col("_low")).cast("double")).alias("at_floor"))


def occupancy_percentiles(passes: DataFrame, value: str) -> DataFrame:
    """Dearest, 90th percentile and median of a value per render, exact."""
    ends = passes.groupBy("render").agg(F.max(value).alias("dearest"))
    return ends.join(quantiles(passes, ["render"], {"p90": (value, 0.9), "median": (value, 0.5)}), "render", "left")


def degradation(passes: DataFrame) -> DataFrame:
    """Sum of the back half of a render's passes over that of the front half; an odd middle pass belongs to the back."""
    n = F.count("*").over(Window.partitionBy("render"))
    front = F.col("pass") <= F.floor(F.col("n") / 2)
    g = passes.withColumn("n", n).groupBy("render").agg(F.sum(F.when(front, F.col("ms"))).alias("front"), F.sum(F.when(~front, F.col("ms"))).alias("back"))
    return g.select("render", "front", "back", ratio(F.col("back"), F.col("front")).alias("slowdown"))


def tenths(passes: DataFrame) -> DataFrame:
    """Sum of ms in each tenth (0 to 9) of a render's passes."""
    n = F.count("*").over(Window.partitionBy("render"))
    return passes.withColumn("tenth", F.floor((F.col("pass") - 1) * 10 / n)).groupBy("render", "tenth").agg(F.sum("ms").alias("ms"))


def per_worker(passes: DataFrame) -> DataFrame:
    """Passes, total, mean and worst ms of each worker, and whether the slowest mean is over 1.5 times the fastest."""
    g = passes.groupBy("worker").agg(F.count("*").alias("passes"), F.sum("ms").alias("total"), F.avg("ms").alias("mean"), F.max("ms").alias("worst"))
    ends = g.agg(ratio(F.max("mean"), F.min("mean")).alias("slowest_to_fastest"))
    return g.crossJoin(ends).withColumn("uneven", F.col("slowest_to_fastest") > 1.5)  # a single row beside the workers


def compare_runs(a: DataFrame, b: DataFrame, workers: int) -> DataFrame:
    """Two runs of passes as one row: wall, floor (paint over workers), p90 and p10 by index, and the gain of b over a; no row where one is empty."""

    def one(df: DataFrame, s: str) -> DataFrame:
        g = df.agg(F.count("*").alias(f"n_{s}"), F.sum("ms").alias(f"paint_{s}"), F.avg("ms").alias(f"mean_{s}"))
        ranks = whole_ranks(df, "ms", {f"p90_{s}": 0.9, f"p10_{s}": 0.1}, "upper")
        return g.filter(f"n_{s} > 0").withColumn(f"floor_{s}", F.col(f"paint_{s}") / workers).crossJoin(ranks)  # two single rows

    both = one(a, "a").crossJoin(one(b, "b"))
    gain = ratio(F.col("mean_a"), F.col("mean_b")) - 1
    return both.withColumn("gain", gain).withColumn("mismatch", F.col("n_a") != F.col("n_b")).withColumn("warn", F.when(F.abs(gain) > 0.10, "over 10 %").when(F.abs(gain) > 0.05, "over 5 %").otherwise("none"))


def mean_by_group_spread(rows: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Mean of a value per inner group, and per outer group the number, least, most and spread of those means."""
    inner = rows.groupBy(group, key).agg(F.avg(value).alias("m"))
    return inner.groupBy(group).agg(F.count("*").alias("groups"), F.min("m").alias("least"), F.max("m").alias("most"), (ratio(F.max("m"), F.min("m")) - 1).alias("spread"))


def size_ladder(rows: DataFrame, width: str, size: str, raw: Column, streamed: Column) -> DataFrame:
    """Per width: rows, median size and its ratio to the raw size; streamed rows are left out."""
    g = rows.filter(~F.coalesce(streamed, F.lit(False))).withColumn("_raw", raw).groupBy(width).agg(F.count("*").alias("n"), F.median(size).alias("median_size"), F.avg("_raw").alias("_raw"))
    return g.select(width, "n", "median_size", ratio(F.col("median_size"), F.col("_raw")).alias("of_raw"))


def best_tile(rows: DataFrame, width: str, tile: str, value: str, tiles: list) -> DataFrame:
    """Mean value by width and tile as a matrix, with the cheapest tile and the percent that it saves over the dearest."""
    g = rows.groupBy(width, tile).agg(F.avg(value).alias("v"))
    best = g.groupBy(width).agg(F.min_by(tile, F.struct("v", tile)).alias("best"), (100 * (1 - ratio(F.min("v"), F.max("v")))).alias("saved"))
    wide = rows.groupBy(width).pivot(tile, tiles).agg(F.avg(value))
    return wide.select(width, *[F.col(f"`{t}`").alias(f"t_{t}") for t in tiles]).join(best, width)


def spread_decomposition(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Relative spread (most over least - 1) with ever more keys held fixed: one pass of grouping sets, then the mean per level."""
    sets = [keys[: i + 1] for i in range(len(keys))]
    g = rows.groupingSets(sets, *keys).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.count("*").alias("n"), F.grouping_id(*keys).alias("g"))
    level = F.lit(0)
    for i in range(len(keys)):
        level = F.when(F.col("g") == (1 << (len(keys) - 1 - i)) - 1, i + 1).otherwise(level)
    return g.filter("n > 1").withColumn("held", level).groupBy("held").agg(F.count("*").alias("groups"), F.avg(ratio(F.col("hi"), F.col("lo")) - 1).alias("spread"))


def marginal_overhead(rows: DataFrame, engine: str, tile: str, ms: str, n: str) -> DataFrame:
    """Between neighbouring tile sizes of an engine: extra ms for each extra pass."""
    w = Window.partitionBy(engine).orderBy(F.desc(tile))
    return rows.withColumn("d_ms", F.col(ms) - F.lag(ms).over(w)).withColumn("d_passes", F.col(n) - F.lag(n).over(w)).filter("d_ms is not null").select(engine, tile, "d_ms", "d_passes", ratio(F.col("d_ms"), F.col("d_passes")).alias("ms_per_pass"))


def overhead_model(rows: DataFrame, engine: str, tile: str, ms: str) -> DataFrame:
    """ms = overhead + paint * tile ** 2 per engine, with the residual and the share of overhead per row."""
    x = F.col(tile).cast("double") * F.col(tile)
    fit = rows.groupBy(engine).agg(F.regr_intercept(F.col(ms), x).alias("overhead"), F.regr_slope(F.col(ms), x).alias("paint"))
    return rows.join(fit, engine).select(engine, tile, "overhead", "paint", (F.col(ms) - F.col("overhead") - F.col("paint") * x).alias("residual"), ratio(F.col("overhead"), F.col(ms)).alias("share"))


def engine_gap(rows: DataFrame, keys: list[str], engine: str, value: str, a: str, b: str) -> DataFrame:
    """Mean value of engine ``b`` over that of ``a``, by keys."""
    wide = rows.groupBy(*keys).pivot(engine, [a, b]).agg(F.avg(value))
    return wide.select(*keys, F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"), ratio(F.col(f"`{b}`"), F.col(f"`{a}`")).alias("gap"))


def path_matrix(rows: DataFrame, material: str, path: str, device: str, ms: str, light: str, paths: tuple[str, str], base: str) -> DataFrame:
    """Mean time by material, path and device: the ratio of the two paths, the ratio to the base device, and how far apart
    the mean light of the two paths is."""
    cell = rows.groupBy(material, device).agg(*[F.avg(F.when(F.col(path) == p, F.col(c))).alias(f"{n}{i}") for i, p in enumerate(paths) for n, c in (("ms", ms), ("light", light))])
    first = F.max(F.when(F.col(device) == base, F.col("ms0"))).over(Window.partitionBy(material))
    return cell.select(material, device, "ms0", "ms1", ratio(F.col("ms0"), F.col("ms1")).alias("path_ratio"), ratio(F.col("ms0"), first).alias("device_ratio"), F.abs(F.col("light0") - F.col("light1")).alias("light_gap"))


def agreement(rows: DataFrame, group: str, engine: str, value: str, reference: float) -> DataFrame:
    """Mean value per group and engine, percent off a reference, and the range across the engines of the group."""
    g = rows.groupBy(group, engine).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(group)
    return g.select(group, engine, "mean", (100 * (F.col("mean") / reference - 1)).alias("percent_off"), (F.max("mean").over(w) - F.min("mean").over(w)).alias("range"))


def tile_invariance(rows: DataFrame, keys: list[str], tile: str, value: str, ms: str) -> DataFrame:
    """The two tiles of a key (least and largest): difference of the mean value, and median and slowest ms of either."""
    g = rows.groupBy(*keys, tile).agg(F.avg(value).alias("v"), F.median(ms).alias("median"), F.max(ms).alias("slowest"))
    a, b = g.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (tile, "v", "median", "slowest")]), g.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (tile, "v", "median", "slowest")])
    return a.join(b, keys).filter(F.col(f"{tile}_a") < F.col(f"{tile}_b")).withColumn("delta", F.col("v_b") - F.col("v_a"))


def payload_gap(files: DataFrame, index: DataFrame, key: str, size: str, payload: str) -> DataFrame:
    """Median and rows of file size over payload by band of file size: below 1000, below 10000, above."""
    band = F.when(F.col(size) < 1000, "small").when(F.col(size) < 10000, "middle").otherwise("large")
    return files.join(index, key).withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"), F.median(ratio(F.col(size), F.col(payload))).alias("median_gap"))


def level_stats(tiles: DataFrame, level: str, size: str) -> DataFrame:
    """Tiles, bytes, bytes per tile and the ratio to the level before."""
    g = tiles.groupBy(level).agg(F.count("*").alias("tiles"), F.sum(size).alias("bytes"))
    return g.withColumn("per_tile", F.col("bytes") / F.col("tiles")).withColumn("to_above", ratio(F.col("bytes"), F.lag("bytes").over(Window.orderBy(level))))  # a row for each level
