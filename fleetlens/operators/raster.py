"""Raster operators over pixel tables (image, x, y, v). Neighbours are window offsets, so nothing is joined that need not be."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written
from .joins import shifted_control_join
from .stats import pearson, ratio


def _row() -> WindowSpec:
    return Window.partitionBy("image", "y").orderBy("x")


def _col() -> WindowSpec:
    return Window.partitionBy("image", "x").orderBy("y")


def image_diff(a: DataFrame, b: DataFrame, w: int, h: int, g: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pixels of a and b by (pair, x, y): mean, largest, percent over 1 and deviation of the difference, and a g x g map of its mean."""
    d = a.join(b.withColumnRenamed("v", "u"), ["pair", "x", "y"]).withColumn("d", F.abs(F.col("v") - F.col("u")))
    whole = d.groupBy("pair").agg(F.avg("d").alias("mean"), F.max("d").alias("most"), (100 * F.avg((F.col("d") > 1).cast("double"))).alias("over_1"), F.stddev_pop(F.col("v") - F.col("u")).alias("sd"))
    cells = d.groupBy("pair", F.least(F.lit(g - 1), F.floor(F.col("x") * g / w)).alias("cx"), F.least(F.lit(g - 1), F.floor(F.col("y") * g / h)).alias("cy")).agg(F.avg("d").alias("mean"))
    return whole, cells


def diff_histogram(pairs: DataFrame) -> DataFrame:
    """Counts of absolute differences by bucket (0, 1, 2, 4, 8, 16, 32, 64: its lower end) per pair, with the mean of the changed and the
    first changed place. ``pairs`` has pair, i, a, b."""
    d = F.abs(F.col("a") - F.col("b"))
    bucket = F.lit(0)
    for low in (1, 2, 4, 8, 16, 32, 64):
        bucket = F.when(F.col("d") >= low, low).otherwise(bucket)
    rows = pairs.withColumn("d", d)
    g = rows.withColumn("bucket", bucket).groupBy("pair", "bucket").agg(F.count("*").alias("n"))
    c = rows.filter("d > 0").groupBy("pair").agg(F.avg("d").alias("mean_changed"), F.min("i").alias("first_changed"))
    return g.join(c, "pair", "left")


def tile_checksums(levels: DataFrame, order: list[str]) -> DataFrame:
    """Mean, lowest, highest, CRC32 of the values as bytes in order, and whether the tile is flat. A tile is bounded by its size."""
    b = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "q"))), lambda p: F.lpad(F.hex(p["q"].cast("long")), 2, "0")), "")
    return levels.groupBy("image").agg(F.avg("q").alias("mean"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.crc32(F.unhex(b)).alias("crc"), (F.min("q") == F.max("q")).alias("flat"))


def _sum_hash(*columns: str) -> Column:
    """A hash of a group of rows as an aggregate that needs no order; repeated rows do not cancel, as the sum and the number of hashes are in it."""
    return F.xxhash64(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.count("*"), F.bit_xor(F.xxhash64(*reversed(columns))))


def tile_hashes(levels: DataFrame, *tile: str) -> DataFrame:
    """One hash of all pixels of each tile of each image, by a mergeable aggregate: (image, the tile's columns, hash)."""
    return levels.groupBy("image", *tile).agg(_sum_hash("y", "x", "q").alias("hash"))


def same_picture(pairs: DataFrame, hashes: DataFrame, pixels: DataFrame, tile: list[str], width: int, mark: Column | None = None) -> DataFrame:
    """Pairs (pair, a, b) of images: same where all tiles have equal hashes; only tiles that differ, or that one image lacks, meet pixel
    by pixel: tiles that differ, differing pixels, the first of them and the largest difference. ``pixels`` has image, the columns of
    ``tile``, x, y and q. mark_shaped: pixels differ, each of them by one and where ``mark``, a rule over x and y, says that marks go.

    Hashes form a tree: the image, then a node for each value of the first column of ``tile`` (its rows), and so on down to the tiles. A pair
    goes down only where its nodes differ, so equal images meet in one row and equal rows of tiles in one each."""
    nodes = [written(hashes, "tile-hashes")]  # read once for each depth
    for depth in range(len(tile) - 1, -1, -1):
        nodes.insert(0, nodes[0].groupBy("image", *tile[:depth]).agg(_sum_hash(tile[depth], "hash").alias("hash")))
    open_at, met = pairs.select("pair", "a", "b"), None
    for depth, level in enumerate(nodes):
        keys = ["pair", *tile[:depth]]
        side = lambda image, name, level=level, depth=depth: (
            open_at.select(*["pair", *tile[: max(0, depth - 1)]], F.col(image).alias("image")).join(level, ["image", *tile[: max(0, depth - 1)]]).select("pair", *tile[:depth], F.col("hash").alias(name))
        )
        both = side("a", "ha").join(side("b", "hb"), keys, "full_outer")
        differing = both.filter(~F.col("ha").eqNullSafe(F.col("hb")))
        if met is None:
            met = both.select("pair", F.col("ha").eqNullSafe(F.col("hb")).alias("same"))  # pairs of which an image is there
        open_at = differing.select(*keys, "ha", "hb").join(pairs.select("pair", "a", "b"), "pair")
    whole = met.join(open_at.groupBy("pair").agg(F.count("*").alias("tiles")), "pair", "left").withColumn("tiles", F.coalesce("tiles", F.lit(0)))
    other = open_at.filter("ha is not null and hb is not null").select("pair", "a", "b", *tile)
    p = other.join(pixels.select(F.col("image").alias("a"), *tile, "x", "y", F.col("q").alias("qa")), ["a", *tile])
    p = p.join(pixels.select(F.col("image").alias("b"), *tile, "x", "y", F.col("q").alias("qb")), ["b", *tile, "x", "y"])
    shaped = F.bool_and((F.abs(F.col("qa") - F.col("qb")) == 1) & mark) if mark is not None else F.lit(False)
    first, worst = F.min(F.col("y") * width + F.col("x")), F.max(F.abs(F.col("qa") - F.col("qb")))
    d = p.filter("qa <> qb").groupBy("pair").agg(F.count("*").alias("differ"), first.alias("first"), worst.alias("worst"), shaped.alias("mark_shaped"))
    return whole.join(d, "pair", "left").withColumns({"differ": F.coalesce("differ", F.lit(0)), "mark_shaped": F.coalesce("mark_shaped", F.lit(False))})


def tile_audit(levels: DataFrame, size: int, recorded: DataFrame, width: int, every: int = 1) -> DataFrame:
    """Of every tile its pixels, wrong size and whether it was never drawn; mean and share over 40 of every ``every``-th pixel in rows of
    ``width``; mismatch: that mean is more than 0.5 from the recorded one."""
    taken = F.pmod(F.col("y") * width + F.col("x"), F.lit(every)) == 0
    g = levels.groupBy("image").agg(F.count("*").alias("n"), (F.count("*") != size).alias("wrong_size"), (~F.bool_or(F.col("q") != 0)).alias("never_drawn"), F.avg(F.when(taken, F.col("q"))).alias("mean"), F.avg(F.when(taken, (F.col("q") > 40).cast("double"))).alias("lit40"))
    return g.join(recorded, "image", "left").withColumn("mismatch", F.abs(F.col("mean") - F.col("recorded")) > 0.5).drop("recorded")


def detail_above(pixels: DataFrame, r: int) -> DataFrame:
    """What a reduction by r loses: mean and largest residual, share over a tenth of the range, share of the variance."""
    block = Window.partitionBy("image", F.floor(F.col("x") / r), F.floor(F.col("y") / r))
    res = F.col("v") - F.avg("v").over(block)
    g = pixels.withColumn("res", res).groupBy("image").agg(F.avg(F.abs("res")).alias("mean_lost"), F.max(F.abs("res")).alias("most_lost"), F.avg((F.abs("res") > 0.1).cast("double")).alias("over"), F.var_pop("res").alias("vr"), F.var_pop("v").alias("vv"))
    return g.select("image", "mean_lost", "most_lost", "over", ratio(F.col("vr"), F.col("vv")).alias("variance_lost"))


def thumbnail(pixels: DataFrame, cell: int, tile: int, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Box mean per cell; a region (x0, y0, x1, y1) grows to whole tiles, and tiles outside are dropped before anything is read."""
    if region is not None:
        x0, y0, x1, y1 = region
        if not (0 <= x0 < x1 and 0 <= y0 < y1):
            raise ValueError(f"bad region {region}")
        x0, y0, x1, y1 = x0 // tile * tile, y0 // tile * tile, -(-x1 // tile) * tile, -(-y1 // tile) * tile
        pixels = pixels.filter(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return pixels.groupBy("image", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.avg("v").alias("v"))


def pyramid_level(levels: DataFrame) -> DataFrame:
    """2 x 2 box of integer colours with unassociated alpha: alpha rounds half up over four, colour is the alpha-weighted mean rounded half
    up, an empty block is zero, and a missing pixel counts as empty. Columns image, x, y, q, a."""
    g = levels.groupBy("image", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.sum(F.col("q").cast("long") * F.col("a")).alias("_qa"), F.sum(F.col("a").cast("long")).alias("_a"))
    return g.select("image", "x", "y", F.when(F.col("_a") > 0, F.expr("(2 * _qa + _a) div (2 * _a)")).otherwise(0).cast("int").alias("q"), F.shiftright(F.col("_a") + 2, 2).cast("int").alias("a"))


def pyramid(levels: DataFrame, width: int, stop: int) -> DataFrame:
    """All levels from 1 until the width is at most ``stop``, each from the one above. The loop is over levels, a logarithm of the width."""
    out, now, level = None, levels, 0
    while width > stop:
        now, level, width = pyramid_level(now), level + 1, -(-width // 2)
        here = now.withColumn("level", F.lit(level))
        out = here if out is None else out.unionByName(here)
    return out if out is not None else pyramid_level(levels).withColumn("level", F.lit(1)).limit(0)


def seam_step(columns: DataFrame, key: str, join_every: int, side: int) -> DataFrame:
    """``columns`` (key, x, v: mean of a column): at every multiple of ``join_every`` a line is fitted to ``side`` columns on either side and
    both are carried to the join; the step between them, beside the same at control columns half way."""
    joins = columns.groupBy(key).agg(F.max("x").alias("_m")).select(key, F.explode(F.sequence(F.lit(join_every // 2), F.col("_m"), F.lit(join_every // 2))).alias("j"))
    near = columns.select(key, "x", "v").withColumn("j", F.explode(F.expr(f"filter(sequence(cast(greatest(x - {side}, 0) as bigint), cast(x + {side} as bigint)), j -> j % {join_every // 2} = 0 and j > 0)")))
    near = near.join(joins, [key, "j"]).filter((F.col("x") >= F.col("j") - side) & (F.col("x") < F.col("j") + side))
    left, d = F.col("x") < F.col("j"), F.col("x") - F.col("j") + 0.5
    g = near.groupBy(key, "j").agg(*[a for n, c in (("l", left), ("r", ~left)) for a in (F.regr_intercept(F.when(c, F.col("v")), F.when(c, d)).alias(n), F.count_if(c).alias(f"n_{n}"))])
    return g.filter((F.col("n_l") == side) & (F.col("n_r") == side)).select(key, "j", (F.col("r") - F.col("l")).alias("step"), (F.col("j") % join_every == 0).alias("is_join"))


def seam_verdict(steps: DataFrame, key: str) -> DataFrame:
    """Joins against control columns: mean absolute step of either, deviation of the control's, z; inconclusive without a control."""
    g = steps.groupBy(key).agg(F.avg(F.when(F.col("is_join"), F.abs("step"))).alias("at_joins"), F.avg(F.when(~F.col("is_join"), F.abs("step"))).alias("at_control"), F.stddev_samp(F.when(~F.col("is_join"), F.abs("step"))).alias("sd"))
    z = ratio(F.col("at_joins") - F.col("at_control"), F.col("sd"))
    return g.withColumn("z", z).withColumn("verdict", F.when(F.col("z").isNull(), "inconclusive").when(F.col("z") > 3, "seam").otherwise("clean"))


def seam_roughness(columns: DataFrame, key: str, join_every: int) -> DataFrame:
    """Median one-column jump at joins against even control columns: ratio over 3 and excess over 0.1 is rough, under 4 joins or 20
    control columns is skipped, a control of zero is inconclusive."""
    jump = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(key).orderBy("x")))
    at = F.col("x") % join_every == 0
    rows = columns.withColumn("jump", jump).filter("jump is not null")
    control = ~at & (F.col("x") % 2 == 0)
    g = rows.groupBy(key).agg(F.median(F.when(at, F.col("jump"))).alias("joins"), F.median(F.when(control, F.col("jump"))).alias("control"), F.count_if(at).alias("n_joins"), F.count_if(control).alias("n_control"))
    v = F.when((F.col("n_joins") < 4) | (F.col("n_control") < 20), "skip").when(F.col("control") == 0, "inconclusive").when((F.col("joins") > 3 * F.col("control")) & (F.col("joins") - F.col("control") > 0.1), "rough").otherwise("smooth")
    return g.withColumn("verdict", v)


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of two masks (pair, x, y, m) of values 0..1: sum of least over sum of greatest, 1 for an empty union."""
    j = a.withColumnRenamed("m", "ma").join(b.withColumnRenamed("m", "mb"), ["pair", "x", "y"], "full_outer").fillna(0.0, ["ma", "mb"])
    return j.groupBy("pair").agg(F.coalesce(ratio(F.sum(F.least("ma", "mb")), F.sum(F.greatest("ma", "mb"))), F.lit(1.0)).alias("iou"))


def dilate(mask: DataFrame, r: int) -> DataFrame:
    """Largest value in the square of 2 r + 1 pixels around each, by a window over rows and one over columns."""
    rows = mask.withColumn("_m", F.max("m").over(_row().rowsBetween(-r, r)))
    return rows.withColumn("m", F.max("_m").over(_col().rowsBetween(-r, r))).drop("_m")


def containment_vs_shift(mask: DataFrame, base: DataFrame, r: int, dx: int, dy: int, w: int, h: int) -> DataFrame:
    """Share of a mask inside the dilated base, and the same for the mask rolled by (dx, dy)."""
    b = dilate(base, r).select("image", "x", "y", F.col("m").alias("b"))
    m = shifted_control_join(mask.select("image", "x", "y", F.col("m").alias("v")), dx, dy, w, h).join(b, ["image", "x", "y"])
    return m.groupBy("image").agg(ratio(F.sum(F.when(F.col("b") > 0, F.col("v")).otherwise(0.0)), F.sum("v")).alias("inside"), ratio(F.sum(F.when(F.col("b") > 0, F.col("shifted")).otherwise(0.0)), F.sum("shifted")).alias("control"))


def stack_verify(masks: DataFrame, source: DataFrame, dx: int, dy: int, w: int, h: int) -> DataFrame:
    """Tiers of masks (image, tier, x, y, m) by largest value against their source: the picture is rebuilt from its ground (median where
    the mask is low) and its 90th percentile where it is high; r with the source less r with the source rolled."""
    top = masks.groupBy("image", "x", "y").agg(F.max("m").alias("m"))
    s = shifted_control_join(source, dx, dy, w, h).join(top, ["image", "x", "y"])
    lv = s.groupBy("image").agg(F.median(F.when(F.col("m") < 0.5, F.col("v"))).alias("ground"), F.percentile(F.when(F.col("m") >= 0.5, F.col("v")), 0.9).alias("vein"))
    p = s.join(lv, "image").withColumn("p", F.col("ground") * (1 - F.col("m")) + F.col("vein") * F.col("m"))
    g = p.groupBy("image").agg(pearson("p", "v").alias("aligned"), pearson("p", "shifted").alias("control"))
    return g.withColumn("gain", F.col("aligned") - F.col("control"))


def gradients(pixels: DataFrame) -> DataFrame:
    """Sobel gradients gx, gy of inner pixels."""
    s = pixels.withColumns({"_d": F.lead("v").over(_row()) - F.lag("v").over(_row()), "_s": F.lag("v").over(_row()) + 2 * F.col("v") + F.lead("v").over(_row())})
    return s.withColumns({"gx": F.lag("_d").over(_col()) + 2 * F.col("_d") + F.lead("_d").over(_col()), "gy": F.lead("_s").over(_col()) - F.lag("_s").over(_col())}).drop("_d", "_s").filter("gx is not null and gy is not null")


def orientation(pixels: DataFrame, q: float = 0.97, least: int = 50) -> DataFrame:
    """Length of the mean doubled gradient direction among pixels at or above the q-quantile of magnitude; 0 below ``least`` of them."""
    g = gradients(pixels).withColumn("mag", F.hypot("gx", "gy"))
    cut = g.groupBy("image").agg(F.percentile("mag", q).alias("cut"))
    k = g.join(cut, "image").filter("mag >= cut").withColumn("a", 2 * F.atan2("gy", "gx"))
    return k.groupBy("image").agg(F.count("*").alias("n"), F.when(F.count("*") < least, 0.0).otherwise(F.hypot(F.avg(F.cos("a")), F.avg(F.sin("a")))).alias("resultant"))


def direction_grid(pixels: DataFrame, cell: int) -> DataFrame:
    """Angle of the structure tensor per cell: half of atan2(2 Jxy, Jxx - Jyy), and its coherence."""
    g = gradients(pixels).groupBy("image", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.sum(F.col("gx") * F.col("gx")).alias("xx"), F.sum(F.col("gy") * F.col("gy")).alias("yy"), F.sum(F.col("gx") * F.col("gy")).alias("xy"))
    return g.select("image", "cx", "cy", (F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"), ratio(F.hypot(F.col("xx") - F.col("yy"), 2 * F.col("xy")), F.col("xx") + F.col("yy")).alias("coherence"))


def mirror_score(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """Pearson r of one half with the other reflected, left to right and top to bottom."""
    flip = lambda axis, n: pixels.select("image", *[(F.lit(n - 1) - F.col(c)).alias(c) if c == axis else F.col(c) for c in ("x", "y")], F.col("v").alias("u"))
    sides = [pixels.filter(F.col(a) < n // 2).join(flip(a, n), ["image", "x", "y"]).groupBy("image").agg(pearson("v", "u").alias(name)) for a, n, name in (("x", w, "left_right"), ("y", h, "top_bottom"))]
    return sides[0].join(sides[1], "image")


def laplacian() -> Column:
    return F.lag("v").over(_row()) + F.lead("v").over(_row()) + F.lag("v").over(_col()) + F.lead("v").over(_col()) - 4 * F.col("v")


def clip_share(pixels: DataFrame, low: float, high: float, bright: float, flat: float) -> DataFrame:
    """Share of inner pixels at either end of the range, and of bright ones, where the absolute Laplacian is small."""
    p = pixels.withColumn("lap", laplacian()).filter("lap is not null")
    calm = F.abs("lap") < flat
    return p.groupBy("image").agg(F.avg((calm & ((F.col("v") <= low) | (F.col("v") >= high))).cast("double")).alias("clipped"), F.avg((calm & (F.col("v") > bright)).cast("double")).alias("specular"))


def blockiness(pixels: DataFrame, block: int) -> DataFrame:
    """Mean absolute step between columns at every ``block``-th one over that of the rest."""
    d = pixels.withColumn("d", F.abs(F.col("v") - F.lag("v").over(_row()))).filter("d is not null")
    at = F.col("x") % block == 0
    return d.groupBy("image").agg(ratio(F.avg(F.when(at, F.col("d"))), F.avg(F.when(~at, F.col("d")))).alias("blockiness"))


def screen_images(mirror: DataFrame, clip: DataFrame, blocky: DataFrame, size: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Notes on an image from its scores: mirrored, clipped, blocky, small; in this order."""
    j = size.join(mirror, "image", "left").join(clip, "image", "left").join(blocky, "image", "left")
    note = lambda c, t: F.when(c, F.lit(t))
    notes = F.array_compact(F.array(note(F.greatest("left_right", "top_bottom") > limits["mirror"], "mirrored"), note(F.col("clipped") > limits["clip"], "clipped"), note(F.col("blockiness") > limits["block"], "blocky"), note(F.col("pixels") < limits["pixels"], "small")))
    return j.select("image", F.concat_ws(",", notes).alias("notes"))


def value_normalise(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Values between the ground (median outside the mask) and the peak (1st or 99th percentile inside, on the mask's side) as 0..1 per
    image: share clamped at either end, interquartile range and mean of the result."""
    p = pixels.join(mask, ["image", "x", "y"])
    inside = F.col("m") >= 0.5
    lv = p.groupBy("image").agg(F.median(F.when(~inside, F.col("v"))).alias("ground"), F.percentile(F.when(inside, F.col("v")), 0.01).alias("p1"), F.percentile(F.when(inside, F.col("v")), 0.99).alias("p99"), F.avg(F.when(inside, F.col("v"))).alias("mi"))
    peak = F.when(F.col("mi") >= F.col("ground"), F.col("p99")).otherwise(F.col("p1"))
    raw = ratio(F.col("v") - F.col("ground"), peak - F.col("ground"))
    n = p.join(lv, "image").withColumn("raw", raw).withColumn("n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw"))))
    return n.groupBy("image").agg(F.avg((F.col("raw") < 0).cast("double")).alias("below"), F.avg((F.col("raw") > 1).cast("double")).alias("above"), F.avg("n").alias("mean"), (F.percentile("n", 0.75) - F.percentile("n", 0.25)).alias("iqr"))


def polarity(pixels: DataFrame, r: int) -> DataFrame:
    """Sign of the skewness of the value less its box mean along the row, scaled by 1.4826 median absolute deviations."""
    f = pixels.withColumn("f", F.col("v") - F.avg("v").over(_row().rowsBetween(-r, r)))
    m = f.groupBy("image").agg(F.median("f").alias("m"))
    d = f.join(m, "image")
    mad = d.groupBy("image").agg((1.4826 * F.median(F.abs(F.col("f") - F.col("m")))).alias("scale"), F.skewness("f").alias("skew"))
    return mad.select("image", "scale", F.signum("skew").cast("int").alias("polarity"))


def smooth_median3x3(grid: DataFrame) -> DataFrame:
    """Upper median of the 3 x 3 cells around each (image, tx, ty, v), those outside the grid being left out."""
    near = grid.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])))
    sent = near.select("image", (F.col("tx") + F.col("_d.a")).alias("tx"), (F.col("ty") + F.col("_d.b")).alias("ty"), F.col("v").alias("_v"))
    g = sent.groupBy("image", "tx", "ty").agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    return grid.join(g, ["image", "tx", "ty"]).select("image", "tx", "ty", F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int")).alias("v"))


@functools.lru_cache(maxsize=4)
def _rings(depth: int, across: int, most: int, y0: int, y1: int, x0: int, x1: int, step: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Of the centres ``first`` to ``last`` of a grid of rows y0 to y1 and columns x0 to x1: column and row of each; the cells within ``most`` of it, and for
    each of these its centre's own bin of whole distances; and how many cells lie below each distance. They depend on sizes alone."""
    cy, cx = (c.ravel()[first:last] for c in np.mgrid[y0:y1:step, x0:x1:step])
    ys, xs = (c.ravel() for c in np.mgrid[0:depth, 0:across])
    ring = np.hypot(xs - cx[:, None], ys - cy[:, None]).astype(np.int64)
    centre, cell = np.nonzero(ring <= most)
    bins = centre * (most + 1) + ring[centre, cell]
    return cx, cy, cell.astype(np.int32), bins.astype(np.int32), _below(bins, None, len(cx), most)


def _below(bins: np.ndarray, weights: np.ndarray | None, centres: int, most: int) -> np.ndarray:
    """Sums below each distance from 0 to most + 1, a row for each centre."""
    sums = np.bincount(bins, weights, minlength=centres * (most + 1)).reshape(centres, most + 1)
    return np.concatenate([np.zeros((centres, 1), sums.dtype), np.cumsum(sums, axis=1)], axis=1)


def _best_circle(f: np.ndarray, inner: int, outer: int) -> tuple[float, int, int, int] | None:
    """(separation, column, row, radius) of the best circle on a grid of rows and columns, or None: coarse centres, then those around the
    best; the first in order of rows, columns and radii among equals. Some million cells, over many centres, are summed at a time."""
    depth, across = f.shape
    least, most = max(3, math.floor(across * 0.04 + 0.5)), math.floor(across * 0.45 + 0.5)
    step = max(1, math.floor(across / 64 + 0.5))
    f = (f - f.mean()).ravel()
    squares = f * f
    r = np.arange(least, most - 5)
    far = np.minimum(most, r + np.maximum(4, r // 2))
    best: tuple[float, int, int, int] | None = None

    def among(y0: int, y1: int, x0: int, x1: int, step: int) -> None:
        nonlocal best
        centres, many = len(range(y0, y1, step)) * len(range(x0, x1, step)), max(1, (1 << 20) // f.size)
        for first in range(0, centres if len(r) else 0, many):
            cx, cy, cell, bins, n = _rings(depth, across, most, y0, y1, x0, x1, step, first, min(first + many, centres))
            s, ss = (_below(bins, v[cell], len(cx), most) for v in (f, squares))
            n_in, n_out = n[:, r + 1], n[:, far + 1] - n[:, r + 2]
            s_out, ss_out = s[:, far + 1] - s[:, r + 2], ss[:, far + 1] - ss[:, r + 2]
            ring = np.maximum(1, n_out)
            sd = np.sqrt(np.maximum(0, ss_out - s_out * s_out / ring) / np.maximum(1, n_out - 1))
            z = (s[:, r + 1] / np.maximum(1, n_in) - s_out / ring) / np.where(sd > 0, sd, 1)
            z = np.where((n_in >= inner) & (n_out >= outer) & (sd > 0) & ~np.isnan(z), z, -np.inf)
            at, i = np.unravel_index(int(z.argmax()), z.shape)
            if z[at, i] > (best[0] if best else -np.inf):
                best = (float(z[at, i]), int(cx[at]), int(cy[at]), int(r[i]))

    among(0, depth, 0, across, step)
    if best and step > 1:
        _, x, y, _ = best
        among(max(0, y - step), min(depth - 1, y + step) + 1, max(0, x - step), min(across - 1, x + step) + 1, 1)
    return best


def radial_step(grid: DataFrame, inner: int = 24, outer: int = 48) -> DataFrame:
    """Per image (image, tx, ty, v: one row a cell) the circle whose inside stands out most over the ring around it, in deviations of the ring: image, cx, cy, r, z,
    and edge, the cells between the centre and the nearest border; images without a fit are left out. Centres are tried on a grid of
    about 64 columns and then one by one around the best; radii go from 4 % to 45 % of the width; an inside of fewer than
    ``inner`` cells or a ring of fewer than ``outer`` is no comparison. Missing cells count as 0. An image is one group, bounded by its
    cells, and images are fitted in parallel; a join of centres with cells would shuffle each cell once per centre."""

    def fit(t: pa.Table) -> pa.Table:
        x, y, v = (t.column(c).to_numpy() for c in ("tx", "ty", "v"))
        f = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        f[y, x] = v
        got = _best_circle(f, inner, outer)
        rows = [] if got is None else [(t.column("image")[0].as_py(), got[1], got[2], got[3], got[0], min(got[1], f.shape[1] - 1 - got[1], got[2], f.shape[0] - 1 - got[2]))]
        kinds = (t.schema.field("image").type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["image", "cx", "cy", "r", "z", "edge"])

    cells = grid.select("image", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.col("v").cast("double").alias("v"))
    return cells.groupBy("image").applyInArrow(fit, f"image {dict(grid.dtypes)['image']}, cx int, cy int, r int, z double, edge int")


def radial_verdict(target: DataFrame, control: DataFrame, key: str = "pair") -> DataFrame:
    """Fits (of radial_step, with ``key``) against those of controls that hold no circle: ratio of the separations and whether the target's is
    usable: refused where the ratio is under 1.8 or the centre lies within a cell of the border; without a control it is unproven."""
    j = target.join(control.select(key, F.col("z").alias("control_z")), key, "left").withColumn("to_control", ratio(F.col("z"), F.col("control_z")))
    verdict = F.when(F.col("edge") <= 1, "at the edge").when(F.col("to_control").isNull(), "unproven").when(F.col("to_control") < 1.8, "too close").otherwise("separated")
    return j.withColumn("verdict", verdict)
