"""Features of images and components, and similarity over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .stats import ratio


def standardise(features: DataFrame, key: str, axis: str, value: str) -> DataFrame:
    """z-score of each axis of a tall feature table (key, axis, value), with population deviation + 1e-9. The axes' moments are one
    aggregate with map-side sums, joined back; there are as many as axes."""
    m = features.groupBy(axis).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return features.join(m, axis).select(key, axis, ((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-9)).alias("z"))


def _spread_axes(vectors: DataFrame, key: str, vector: str, dims: int, most: int = 4096) -> np.ndarray:
    """``dims`` orthonormal directions of largest spread, from at most ``most`` vectors; any such directions give the same pairs."""
    rows = vectors.filter(F.size(vector) > 0).orderBy(F.xxhash64(key)).limit(most).select(vector).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows], float)
    x -= x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims].T


#: Tasks of pair_within at most.
_MOST_TASKS = 20_000


def pair_within(vectors: DataFrame, key: str, vector: str, radius: float, dims: int = 3, block: int | None = None) -> DataFrame:
    """Pairs (a < b) of vectors at a Euclidean distance of at most ``radius``, none lost.

    Vectors are projected on ``dims`` orthonormal directions of large spread, which shortens no distance's lower bound, and cut into
    cells as wide as the radius. A vector stays in its cell and visits the half of the neighbouring cells that come after it, so each
    pair meets once. Cells are split into blocks of about ``block`` vectors a side (by default some 8 MB of them), each pair of blocks a group's
    matrix product, whose pairs leave it in parts. There are as many tasks as pairs of blocks fill, so what a task sorts and holds does not
    grow with the vectors. Where the radius is wide against the spread of the data there are few cells and the work is that of all
    pairs, in blocks: products and the vectors dealt to them then grow with the square. All vectors are of one length, without nulls
    inside; null vectors and keys take no part, and rows of one key never meet.
    """
    axes = _spread_axes(vectors, key, vector, dims)
    own = dict(vectors.dtypes)[key]
    if not len(axes):
        return vectors.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("distance")).filter(F.lit(False))
    block = block or max(256, (1 << 20) // axes.shape[1])
    width = radius if radius > 0 else 1.0
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    dot = lambda axis: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in axis]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cells = [f"c{i}" for i in range(len(axes))]
    home = written(rows.select("k", "v", *[F.floor(dot(a) / width).alias(c) for a, c in zip(axes, cells, strict=True)]), "cells")
    after = [s for s in product((-1, 0, 1), repeat=len(axes)) if s > (0,) * len(axes)]
    guests = home.withColumn("_s", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in after])))
    guests = guests.select("k", "v", *[(F.col(c) + F.col("_s")[i]).alias(c) for i, c in enumerate(cells)], F.lit(True).alias("guest"))
    home = home.withColumn("guest", F.lit(False))
    others = home.unionByName(guests)
    sizes = others.groupBy(*cells).agg(F.count_if(~F.col("guest")).alias("_h"), F.count("*").alias("_n")).filter("_h > 0")
    sizes = written(sizes.select(*cells, "_h", "_n", F.ceil(F.col("_h") / block).cast("int").alias("nx"), F.ceil(F.col("_n") / block).cast("int").alias("ny")), "cell-sizes")
    dealt = sizes.agg(F.sum(F.col("_h") * F.col("ny") + F.col("_n") * F.col("nx")).alias("rows"), F.sum(F.col("nx").cast("long") * F.col("ny")).alias("pairs")).first()
    least = min(dealt["pairs"] or 1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(_MOST_TASKS, max(least, -(-(dealt["rows"] or 1) // (2 * block))))
    sizes = sizes.drop("_h", "_n")
    home, others = (df.repartition(-(-tasks // 2), "k") for df in (home, others))  # a task's copies are bounded too
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = home.join(sizes, cells).select("k", "v", *cells, "guest", part("nx").alias("x"), every("ny").alias("y"), F.lit(True).alias("left"))
    right = others.join(sizes, cells).select("k", "v", *cells, "guest", every("nx").alias("x"), part("ny").alias("y"), F.lit(False).alias("left"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        is_left, guest = t.column("left").to_numpy(), t.column("guest").to_numpy()
        keys = t.column("k").to_numpy(zero_copy_only=False)
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        kind = t.schema.field("k").type
        i, j = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        norm = (v * v).sum(axis=1)
        half = ((1 - 1e-9) * norm - (radius * radius + 1e-9) / 2) / 2  # the product of two within the radius is at least the sum of theirs
        others, bound = v[j], half[j]
        for s in range(0, len(i), 128):
            p = i[s : s + 128]
            product = v[p] @ others.T
            product -= bound
            r, c = np.nonzero(product >= half[p][:, None])
            for m in range(0, len(r), 1 << 16):
                x, y = p[r[m : m + (1 << 16)]], j[c[m : m + (1 << 16)]]
                fit = guest[y] & (keys[x] != keys[y]) | (keys[x] < keys[y])
                x, y = x[fit], y[fit]
                d = np.sqrt(((v[x] - v[y]) ** 2).sum(axis=1))
                near = d <= radius
                a, b = keys[x[near]], keys[y[near]]
                if len(a):
                    low = a < b
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.where(low, a, b), kind), "b": pa.array(np.where(low, b, a), kind), "distance": pa.array(d[near], pa.float64())})

    met = left.unionByName(right).repartition(tasks, *cells, "x", "y")
    return met.groupBy(*cells, "x", "y").applyInArrow(meet, f"a {own}, b {own}, distance double")


def nearest_pairs(vectors: DataFrame, key: str, vector: str, k: int, sample: int = 1000) -> DataFrame:
    """The ``k`` closest pairs (a < b) of all, nearest first, equals by a and b. The k-th distance among a bounded sample bounds the k-th
    of all, so the pairs within it hold the answer."""
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(key, vector).collect()
    x = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    d = np.concatenate([np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(axis=1)) for i in range(len(x))]) if len(x) > 1 else np.zeros(1)
    bound = float(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1] if len(d) >= k else d.max()) * (1 + 1e-9)
    return pair_within(vectors, key, vector, bound).orderBy("distance", "a", "b").limit(k)


#: Rows of pairs, edges or points that a task of the thinning sorts, about.
_ROWS_A_TASK = 1 << 20


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows``, which are on disk, by key in as many parts as ``_ROWS_A_TASK`` asks for, to be merged with what is joined to them: neither side is
    broadcast, as files of few bytes may hold very many rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-rows.count() // _ROWS_A_TASK)
    return (rows.repartition(min(_MOST_TASKS, parts), *by) if parts > least else rows).hint("merge")


def _thin_edges(live: DataFrame, before: DataFrame) -> DataFrame:
    """The points of ``live`` (r, p) that a walk in order of priority keeps, given edges ``before`` (r, a, b) from each point to its neighbours of
    higher priority. A round keeps every point without such a neighbour left and drops the neighbours of those; what a round settles,
    the points left and the edges left are written to the shared folder."""
    kept = []
    while not live.isEmpty():
        blocked = _dealt(before, "r", "a").select("r", F.col("a").alias("p")).distinct().withColumn("_blocked", F.lit(True))
        free = written(_dealt(live, "r", "p").join(blocked, ["r", "p"], "left").filter("_blocked is null").select("r", "p"), "thin-kept")
        kept.append(free)
        gone = _dealt(before, "r", "b").join(free.select("r", F.col("p").alias("b")), ["r", "b"], "left_semi").select("r", F.col("a").alias("p")).distinct()
        settled = written(free.unionByName(gone), "thin-settled")
        live = written(_dealt(live, "r", "p").join(settled, ["r", "p"], "left_anti"), "thin-live")
        for side in ("a", "b"):
            before = written(_dealt(before, "r", side).join(settled.withColumnRenamed("p", side), ["r", side], "left_anti"), "thin-edges")
    return reduce(DataFrame.unionByName, kept) if kept else live


def radius_thin(points: DataFrame, key: str, vector: str, priority: str, radii: tuple[float, ...], pivots: int = 512, share: float = 0.125) -> DataFrame:
    """Greedy thinning at several radii at once: (radius, and the columns of ``points``) of the points kept. In order of priority (largest first,
    then least key) a point is kept if it is farther than the radius from all points kept before it.

    First, in passes that all radii share, the foremost ``pivots`` points left at each radius are settled among themselves (a bounded
    number of vectors on the driver), and one scan drops what lies within the radius of those kept: where the radius is wide few passes
    settle all, and no pairs are built. A radius leaves the passes once one settles less than ``share`` of its points: then few points lie
    near each other, so the pairs within the radius are found once, with their distances, for all such radii, and rounds over these edges
    settle the rest. Both give what the walk in order gives. Rows with a null key or vector take no part; keys are unique.

    Of equal vectors only the foremost is walked: what keeps or drops it is as near to the others, and it drops them where it is kept. So
    copies make no pairs.
    """
    own = points.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = own.select(F.col(key).alias("p"), F.col(vector).cast("array<double>").alias("v"), F.col(priority).cast("double").alias("w"))
    foremost = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("w"), "p"))
    rows = rows.withColumn("_n", foremost).filter("_n = 1").drop("_n")
    live = written(rows.withColumn("left", F.array(*[F.lit(True)] * len(radii))), "thin-points")
    kind, dense, kept = dict(points.dtypes)[key], set(range(len(radii))), []
    spark = points.sparkSession

    def count(i: int) -> Column:
        return F.count_if(F.col("left")[i]).alias(str(i))

    left = live.agg(*[count(i) for i in range(len(radii))]).first()
    while dense := {i for i in dense if left[i]}:
        settled, near = {}, {}
        for i in sorted(dense):
            front = live.filter(F.col("left")[i]).orderBy(F.desc("w"), "p").limit(pivots).select("p", "v").collect()  # ``pivots`` rows at most
            x = np.array([r.v for r in front], float)
            free = np.ones(len(x), bool)
            for j in range(len(x)):
                if free[j]:
                    free[j + 1 :] &= np.sqrt(((x[j + 1 :] - x[j]) ** 2).sum(axis=1)) > radii[i]
            near[i] = x[free]
            settled[i] = {r.p for r in front}
            kept += [(i, r.p) for r, f in zip(front, free, strict=True) if f]
        shared = spark.sparkContext.broadcast((near, settled, [float(r) for r in radii]))

        def drop(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            near, settled, radii = shared.value
            for b in batches:
                v = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                left = np.asarray(b.column(3).flatten()).reshape(b.num_rows, -1).copy()
                keys = b.column(0).to_pylist()
                for i, x in near.items():
                    for k in np.flatnonzero(left[:, i]).tolist():
                        left[k, i] = keys[k] not in settled[i] and bool((np.sqrt(((x - v[k]) ** 2).sum(axis=1)) > radii[i]).all())
                lists = pa.ListArray.from_arrays(np.arange(0, left.size + 1, left.shape[1], dtype=np.int32), pa.array(left.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], names=["p", "v", "w", "left"])

        live = written(live.mapInArrow(drop, live.schema).filter(F.array_contains("left", True)), "thin-points")
        now = live.agg(*[count(i) for i in range(len(radii))]).first()
        dense = {i for i in dense if left[i] - now[i] >= share * left[i] or now[i] <= pivots}
        left = now
    found = spark.createDataFrame(kept, f"_r int, p {kind}")
    sparse = [i for i in range(len(radii)) if left[i]]
    if sparse:
        pairs = written(pair_within(live, "p", "v", max(radii[i] for i in sparse)), "thin-pairs")
        states = live.select("p", F.posexplode("left").alias("r", "_left")).filter("_left").select("r", "p")
        for side in ("a", "b"):  # a pair takes up its points' priorities and states once, whatever the radii
            pairs = written(_dealt(pairs, side).join(live.select(F.col("p").alias(side), F.col("w").alias(f"w{side}"), F.col("left").alias(f"left_{side}")), side), "thin-pairs")
        wide = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(float(radii[i])).alias("at"), (F.col("left_a")[i] & F.col("left_b")[i]).alias("both")) for i in sparse])).alias("_r")
        edges = pairs.select("a", "b", "wa", "wb", "distance", wide).filter((F.col("distance") <= F.col("_r.at")) & F.col("_r.both")).select("_r.r", "a", "b", "wa", "wb")
        first = (F.col("wa") > F.col("wb")) | (F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b"))
        before = edges.select("r", F.when(first, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("b"))
        rest = _thin_edges(written(states, "thin-live"), written(before, "thin-edges"))
        found = found.unionByName(rest.select(F.col("r").alias("_r"), "p"))
    at = F.array(*[F.lit(float(r)) for r in radii])
    return own.join(found, own[key] == found["p"]).select(at[F.col("_r")].alias("radius"), *points.columns)


def layer_fingerprint(components: DataFrame, area_total: float, directions: DataFrame | None = None) -> DataFrame:
    """Per image and tier: coverage, components per million of area, median and deviation of ln width and of ln length over width, and the
    direction of the image's structure (image, resultant; see ``raster.orientation``), 0 where none was measured."""
    lw, ls = F.log("width"), F.log(F.col("length") / F.col("width"))
    g = components.filter((F.col("width") > 0) & (F.col("length") > 0)).groupBy("image", "tier").agg(
        (F.sum("area") / area_total).alias("coverage"), (F.count("*") * 1e6 / area_total).alias("density"),
        F.median(lw).alias("width_median"), F.stddev_pop(lw).alias("width_sd"), F.median(ls).alias("slender"), F.stddev_pop(ls).alias("slender_sd"),
    )
    if directions is None:
        return g.withColumn("direction", F.lit(0.0))
    return g.join(directions.select("image", F.col("resultant").alias("_d")), "image", "left").withColumn("direction", F.coalesce("_d", F.lit(0.0))).drop("_d")


#: Where the first means lie among an image's widths, and what is added to a width before its logarithm.
BREAK_SEEDS, LEAST_WIDTH = (0.15, 0.85), 1e-6


def width_breaks(components: DataFrame, k: int = 3, rounds: int = 40) -> DataFrame:
    """Break points of an image's ln widths by k-means in one dimension: the midpoints between neighbouring means, empty where there are fewer
    than k widths. Clusters on a line are intervals, so a round is a search for the midpoints among the sorted distinct widths and two
    differences of prefix sums. The widths of an image are first counted by value; a group is as large as its distinct widths."""
    import pandas as pd

    def means(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        count, total = np.append(0, np.cumsum(n)), np.append(0.0, np.cumsum(n * x))
        place = np.linspace(*BREAK_SEEDS, k) * (count[-1] - 1)  # quantiles of all widths, between neighbours by share
        low, high = (x[np.searchsorted(count[1:], f(place).astype(int), side="right")] for f in (np.floor, np.ceil))
        c = low + (high - low) * (place % 1)
        for _ in range(rounds):
            cuts = np.concatenate(([0], np.searchsorted(x, (c[1:] + c[:-1]) / 2, side="right"), [len(x)]))
            size = np.diff(count[cuts])
            moved = np.sort(np.where(size > 0, np.diff(total[cuts]) / np.maximum(size, 1), c))
            if np.abs(moved - c).max() <= 1e-12:
                break
            c = moved
        return c

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("width")
        breaks: list[float] = []
        if pdf["n"].sum() >= k:
            c = means(np.log(pdf["width"].to_numpy() + LEAST_WIDTH), pdf["n"].to_numpy())
            breaks = np.exp((c[1:] + c[:-1]) / 2).tolist()
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "breaks": [breaks]})

    counted = components.filter("width >= 0").groupBy("image", "width").agg(F.count("*").alias("n"))
    return counted.groupBy("image").applyInPandas(fit, f"image {dict(components.dtypes)['image']}, breaks array<double>")


#: Fine cells across the greatest distance that counts as near.
_FINE = 8


def distance_to_nearest(points: DataFrame, sources: DataFrame, most: float, by: str, key: str, few: int = 256) -> DataFrame:
    """``points`` with the Euclidean distance (x, y) to the nearest of ``sources`` of the same ``by``, null at ``most`` and beyond; exact.

    Sources go to the tiles, twice ``most`` wide, that a point near them may lie in, four at most. Where a tile has at most ``few``, they are
    one row beside its points, whose distances are measured in place; nothing is exploded and nothing joined back. Points in tiles of
    more sources go by fine cells. Sources in one place count once."""
    wide = 2 * most
    tile = lambda c, by=0.0: F.floor((F.col(c) + by) / wide)
    p = points.withColumns({"_tx": tile("x"), "_ty": tile("y")})
    s = sources.select(by, F.col("x").alias("sx"), F.col("y").alias("sy")).filter(F.col(by).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
    near = s.withColumn("_tx", F.explode(F.sequence(tile("sx", -most), tile("sx", most)))).withColumn("_ty", F.explode(F.sequence(tile("sy", -most), tile("sy", most))))
    tiles = [by, "_tx", "_ty"]
    crowded = written(near.groupBy(*tiles).agg(F.count("*").alias("_n")).filter(F.col("_n") > few).select(*tiles), "crowded-tiles")
    dense = not crowded.isEmpty()
    if dense:
        near = near.join(crowded, tiles, "left_anti")
    lists = near.groupBy(*tiles).agg(F.collect_list(F.struct("sx", "sy")).alias("_near"))  # ``few`` at most
    least = F.array_min(F.transform("_near", lambda c: F.hypot(F.col("x") - c["sx"], F.col("y") - c["sy"])))
    rest = p.join(crowded, tiles, "left_anti") if dense else p
    out = rest.join(lists, tiles, "left").withColumn("distance", F.when(least < most, least)).select(*points.columns, "distance")
    if dense:
        out = out.unionByName(_distance_by_cells(p.join(crowded, tiles, "left_semi").select(*points.columns), s, most, by, key))
    return out


def _distance_by_cells(points: DataFrame, sources: DataFrame, most: float, by: str, key: str) -> DataFrame:
    """The same where sources (by, sx, sy) stand close. Both are dealt to fine cells. The occupied ones around a tile of cells, of a
    bounded number, are one row; of these a ring search bounds the nearest distance from above by the cell whose farthest corner is nearest, and
    only cells whose nearest corner lies within that bound meet point by point. So dense parts, where a source is in the same cell or
    beside it, meet few cells, and pairs do not grow with ``most``."""
    side, reach = most / _FINE, _FINE + 1
    cell = lambda c: F.floor(F.col(c) / side)
    tile = lambda c: F.floor(c / (2 * _FINE))
    p = points.select(by, key, "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    s = sources.withColumns({"ex": cell("sx"), "ey": cell("sy")})
    around = s.select(by, "ex", "ey").distinct()
    for t, c in (("_tx", "ex"), ("_ty", "ey")):
        around = around.withColumn(t, F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    around = around.groupBy(by, "_tx", "_ty").agg(F.collect_list(F.struct("ex", "ey")).alias("_cells"))
    own = p.select(by, "cx", "cy").distinct().withColumns({"_tx": tile(F.col("cx")), "_ty": tile(F.col("cy"))}).join(around, [by, "_tx", "_ty"])
    gap = lambda c, d: F.greatest(F.abs(c - F.col(d)) - 1, F.lit(0))
    high = F.array_min(F.transform("_cells", lambda c: F.hypot(F.abs(c["ex"] - F.col("cx")) + 1, F.abs(c["ey"] - F.col("cy")) + 1)))
    low = lambda c: F.hypot(gap(c["ex"], "cx"), gap(c["ey"], "cy"))
    met = own.withColumn("_high", high).select(by, "cx", "cy", F.explode(F.filter("_cells", lambda c: (low(c) <= F.col("_high")) & (low(c) < _FINE))).alias("_e"))
    pairs = p.join(met.select(by, "cx", "cy", "_e.ex", "_e.ey"), [by, "cx", "cy"]).join(s, [by, "ex", "ey"])
    nearest = pairs.groupBy(by, key).agg(F.min(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).alias("distance")).filter(F.col("distance") < most)
    return points.join(nearest, [by, key], "left")


def assign_tiers(components: DataFrame, breaks: DataFrame, gauge: float, near: float, key: str = "id") -> DataFrame:
    """Tier of each component (image, key, width, length, x, y), and its distance to the major network: major from the upper break on; minor
    from the lower break on if its distance to the image's nearest major one is below ``near``; of the rest subminor where the
    length is three widths or more, else micro. ``distance`` is 0 for major ones and null where none is near. Images without two breaks are split
    at ``gauge`` and half of it. Keys are unique in an image."""
    hi, lo = F.coalesce(F.try_element_at("breaks", F.lit(2)), F.lit(gauge)), F.coalesce(F.try_element_at("breaks", F.lit(1)), F.lit(gauge / 2))
    sized = components.join(breaks, "image", "left").withColumns({"_major": F.col("width") >= hi, "_wide": F.col("width") >= lo}).drop("breaks")
    far = distance_to_nearest(sized.filter("not _major"), sized.filter("_major"), near, "image", key)
    rest = F.when(F.col("length") >= 3 * F.col("width"), "subminor").otherwise("micro")
    minor = far.withColumn("assigned", F.when(F.col("_wide") & F.col("distance").isNotNull(), "minor").otherwise(rest))
    major = sized.filter("_major").withColumns({"distance": F.lit(0.0), "assigned": F.lit("major")})
    unsized = sized.filter("_major is null").withColumns({"distance": F.lit(None).cast("double"), "assigned": rest})
    return major.unionByName(minor).unionByName(unsized).drop("_major", "_wide")


def stroke_share(components: DataFrame) -> DataFrame:
    """Of an image's components at or below its median width, the share whose length is three widths or more."""
    med = components.groupBy("image").agg(F.median("width").alias("_m"))
    thin = components.join(med, "image").filter("width <= _m")
    return thin.groupBy("image").agg(F.avg((F.col("length") >= 3 * F.col("width")).cast("double")).alias("share"))


def pen_capability(events: DataFrame, kind: str, pressure: str, tilt: str, hover: str, t: str, points: str) -> DataFrame:
    """Per pointer kind: events, and tilted and hovering ones; of those that press, distinct pressures at three digits, their range, points a
    second and points an event (``points``: how many an event stands for). Verdict: none where nothing but the placeholder 0.5 is
    reported, on-off for one or two of 0, 0.5 and 1, levels for eight or more over a range above 0.2, else maybe. A null hover presses."""
    down = ~F.coalesce(F.col(hover), F.lit(False))
    p = F.when(down, F.round(pressure, 3))
    n_points = F.sum(F.when(down, F.col(points)))
    g = events.groupBy(kind).agg(
        F.count("*").alias("n"), F.count_distinct(p).alias("levels"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.coalesce(F.bool_and(p.isin(0.0, 0.5, 1.0)), F.lit(False)).alias("_plain"),
        F.count_if(F.col(tilt) != 0).alias("tilted"), F.count_if(F.col(hover)).alias("hovering"), n_points.alias("_p"),
        (n_points / F.greatest(F.count_if(down), F.lit(1))).alias("points_per_event"), ((F.max(F.when(down, F.col(t))) - F.min(F.when(down, F.col(t)))) / 1e6).alias("_s"),
    )
    v = F.when((F.col("levels") == 1) & (F.col("lo") == 0.5), "none").when((F.col("levels") <= 2) & F.col("_plain"), "on-off").when((F.col("levels") >= 8) & (F.col("hi") - F.col("lo") > 0.2), "levels").otherwise("maybe")
    return g.withColumns({"verdict": v, "per_second": ratio(F.col("_p"), F.col("_s"))}).drop("_s", "_p", "_plain")


def best_candidates(items: DataFrame, key: str, score: str, prefer: list, name: str, per: int) -> DataFrame:
    """Of each key's items those of the best score, preferred flags first (true before false), then by name; at most ``per``."""
    w = Window.partitionBy(key)
    top = items.withColumn("_top", F.max(score).over(w)).filter(F.col(score) == F.col("_top")).drop("_top")
    return top.withColumn("place", F.row_number().over(w.orderBy(*[F.desc(p) for p in prefer], name)).cast("long")).filter(F.col("place") <= per)


def slowest(passes: DataFrame, key: str, ms: str, order: list[str], n: int) -> DataFrame:
    """The n slowest passes of each key with their ratio to its median; equals go by ``order``."""
    med = passes.groupBy(key).agg(F.median(ms).alias("_m"))
    top = passes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ms), *order)).cast("long")).filter(F.col("place") <= n)
    return top.join(med, key).withColumn("to_median", ratio(F.col(ms), F.col("_m"))).drop("_m")


def biggest(rows: DataFrame, size: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(size), key).limit(n)


def mid_stratum_sample(tiles: DataFrame, key: str, index: str, n: int) -> DataFrame:
    """The middle tile of each of min(n, total) equal strata of a key: index (from 0, without gaps) floor((i + 1/2) * total / strata). Whole numbers
    decide, so no rounding moves a pick."""
    total = tiles.groupBy(key).agg(F.count("*").alias("_n"))
    rows = tiles.join(total, key).withColumn("_m", F.least(F.lit(n).cast("long"), F.col("_n")))
    i = F.expr(f"(2 * _m * {index} + _n - 1) div (2 * _n)")  # the first stratum whose middle is not before the index
    rows = rows.withColumn("_i", i)
    return rows.filter((F.col("_i") < F.col("_m")) & (F.expr("((2 * _i + 1) * _n) div (2 * _m)") == F.col(index))).drop("_n", "_m", "_i")


def systematic_sample(tiles: DataFrame, key: str, index: str, n: int) -> DataFrame:
    """About n tiles of each key, evenly spread: index modulo max(1, floor(total / n)) is zero. The total is an aggregate joined back."""
    total = tiles.groupBy(key).agg(F.count("*").alias("_n"))
    return tiles.join(total, key).filter(F.pmod(F.col(index), F.greatest(F.lit(1), F.floor(F.col("_n") / n))) == 0).drop("_n")


def order_index(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in order of the keys as the index shows them: numbers as such, missing values as "-"."""
    kinds = dict(rows.dtypes)
    return rows.orderBy(*[F.coalesce(F.col(k), F.lit("-")) if kinds[k] == "string" else F.col(k) for k in keys])


def order_stats(rows: DataFrame, by: str, *ties: str) -> DataFrame:
    """Rows by one of their totals, the largest first, except widths, which go up."""
    return rows.orderBy(F.col(by) if by == "w" else F.desc(by), *ties)
