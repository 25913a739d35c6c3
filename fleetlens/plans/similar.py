"""Queries over features, components, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import raster
from ..operators import similar as op
from . import tables as t
from .fleet import rounded
from .raster import DIRECTIONS
from .registry import query


def vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("v"))


_PAIRS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(distance, 6) AS distance FROM pr WHERE distance <= 1.0")
def c11_pair_within(spark, sf):
    return rounded(op.pair_within(vectors(spark, sf), "image", "v", 1.0), 6)


@query(f"WITH {_PAIRS} SELECT a, b, round(distance, 6) AS distance FROM pr ORDER BY pr.distance, a, b LIMIT 8")
def c11_nearest_pairs(spark, sf):
    return rounded(op.nearest_pairs(vectors(spark, sf), "image", "v", 8), 6)


@query("""SELECT vec_id AS image, p AS axis, round((embedding[p] - avg(embedding[p]::DOUBLE) OVER (PARTITION BY p)) / (stddev_pop(embedding[p]::DOUBLE) OVER (PARTITION BY p) + 1e-9), 6) AS z FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings)""")
def d55_standardise(spark, sf):
    tall = vectors(spark, sf).select("image", F.posexplode("v").alias("p", "value")).select("image", (F.col("p") + 1).cast("long").alias("axis"), "value")
    return rounded(op.standardise(tall, "image", "axis", "value"), 6)


#: The radii at which thinning is judged.
RADII = (0.6, 0.9, 1.2, 1.6, 2.2, 3.0)


@query(f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT unnest([0.6, 0.9, 1.2, 1.6, 2.2, 3.0])::DOUBLE AS radius), e AS (SELECT radius, a, b FROM pr, r WHERE distance <= radius UNION ALL SELECT radius, b, a FROM pr, r WHERE distance <= radius),
 n AS MATERIALIZED (SELECT radius, a, list(b) AS near FROM e GROUP BY ALL),
 o AS MATERIALIZED (SELECT r.radius, row_number() OVER (PARTITION BY r.radius ORDER BY label DESC, vec_id) AS i, vec_id, coalesce(near, []) AS near FROM embeddings CROSS JOIN r LEFT JOIN n ON a = vec_id AND n.radius = r.radius),
 k(radius, i, kept) AS (SELECT radius, 0::BIGINT, []::BIGINT[] FROM r UNION ALL SELECT k.radius, o.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, vec_id) END FROM k JOIN o ON o.i = k.i + 1 AND o.radius = k.radius)
SELECT radius, image, label FROM (SELECT radius, unnest(kept) AS image FROM (SELECT radius, arg_max(kept, i) AS kept FROM k GROUP BY radius)) JOIN embeddings ON vec_id = image""")
def f8_radius_thin(spark, sf):
    """Survivors at all six radii; the label is the priority."""
    points = vectors(spark, sf).join(t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), "label"), "image")
    return op.radius_thin(points, "image", "v", "label", RADII).select("radius", "image", "label")


@query(f"""WITH {t.COMPONENTS}, {DIRECTIONS}, layers AS (SELECT image, tier, round(sum(area) / 1e8, 6) AS coverage, round(count(*) * 1e6 / 1e8, 6) AS density, round(median(ln(width)), 6) AS width_median, round(stddev_pop(ln(width)), 6) AS width_sd,
 round(median(ln(length / width)), 6) AS slender, round(stddev_pop(ln(length / width)), 6) AS slender_sd FROM components WHERE width > 0 AND length > 0 GROUP BY 1, 2)
SELECT layers.*, coalesce(resultant, 0) AS direction FROM layers LEFT JOIN directions USING (image)""")
def d54_layer_fingerprint(spark, sf):
    """The rasters of the vectors stand in for the images' masks."""
    directions = raster.orientation(t.pixels(spark, sf), 0.5, 10)
    return rounded(op.layer_fingerprint(t.components(spark, sf), 1e8, directions), 6)


_NEAREST = "CASE WHEN abs(x - a) <= abs(x - b) AND abs(x - a) <= abs(x - c) THEN 1 WHEN abs(x - b) <= abs(x - c) THEN 2 ELSE 3 END"
_MEANS = ", ".join(f"coalesce(sum(x * n) FILTER (o = {i}) / sum(n) FILTER (o = {i}), any_value({c}))" for i, c in ((1, "a"), (2, "b"), (3, "c")))


@query(f"""WITH RECURSIVE {t.COMPONENTS}, w AS (SELECT image, ln(width + 1e-6) AS x, count(*) AS n FROM components WHERE width >= 0 GROUP BY image, width),
 seed AS (SELECT image, quantile_cont(ln(width + 1e-6), 0.15) AS a, quantile_cont(ln(width + 1e-6), 0.5) AS b, quantile_cont(ln(width + 1e-6), 0.85) AS c, count(*) AS total FROM components WHERE width >= 0 GROUP BY image),
 km(image, r, a, b, c) AS (SELECT image, 0, a, b, c FROM seed UNION ALL SELECT image, r + 1, m[1], m[2], m[3] FROM (SELECT image, r, list_sort([{_MEANS}]) AS m FROM (SELECT k.*, w.x, w.n, {_NEAREST} AS o FROM km k JOIN w USING (image) WHERE r < 40) GROUP BY image, r))
SELECT image, CASE WHEN total >= 3 THEN round(exp((km.a + km.b) / 2), 6) END AS lower, CASE WHEN total >= 3 THEN round(exp((km.b + km.c) / 2), 6) END AS upper FROM km JOIN seed USING (image) WHERE r = 40""")
def d56_width_breaks(spark, sf):
    at = lambda i: F.round(F.try_element_at("breaks", F.lit(i)), 6)
    return op.width_breaks(t.components(spark, sf)).select("image", at(1).alias("lower"), at(2).alias("upper"))


_BREAKS = "br AS (SELECT image, quantile_cont(width, 0.33) AS b1, quantile_cont(width, 0.67) AS b2 FROM components WHERE image % 4 > 0 GROUP BY image)"


@query(f"""WITH {t.COMPONENTS}, {_BREAKS}, z AS (SELECT c.*, width >= coalesce(b2, 30) AS major, width >= coalesce(b1, 15) AS wide FROM components c LEFT JOIN br USING (image)),
 d AS (SELECT a.image, a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM z a JOIN z b ON a.image = b.image AND b.major AND NOT a.major GROUP BY 1, 2)
SELECT z.image, z.id, CASE WHEN major THEN 'major' WHEN wide AND d < 25 THEN 'minor' WHEN length >= 3 * width THEN 'subminor' ELSE 'micro' END AS assigned, round(CASE WHEN major THEN 0 WHEN d < 25 THEN d END, 6) AS distance
FROM z LEFT JOIN d USING (image, id)""")
def d57_assign_tiers(spark, sf):
    c = t.components(spark, sf)
    breaks = c.filter("image % 4 > 0").groupBy("image").agg(F.array(F.percentile("width", 0.33), F.percentile("width", 0.67)).alias("breaks"))
    return rounded(op.assign_tiers(c, breaks, 30.0, 25.0).select("image", "id", "assigned", "distance"), 6)


@query(f"""WITH {t.COMPONENTS}, m AS (SELECT image, median(width) AS m FROM components GROUP BY image) SELECT image, round(avg((length >= 3 * width)::INT), 6) AS share FROM components JOIN m USING (image) WHERE width <= m GROUP BY image""")
def d58_stroke_share(spark, sf):
    return rounded(op.stroke_share(t.components(spark, sf)), 6)


@query(f"""WITH {t.SAMPLES}, e AS (SELECT *, id % 5 > 0 AS down, CASE WHEN id % 5 > 0 THEN CASE kind WHEN 'view' THEN 0.5 WHEN 'click' THEN (id % 3) / 2 ELSE round(value / 500, 3) END END AS p FROM samples),
 g AS (SELECT kind, count(*) AS n, count(DISTINCT p) AS levels, min(p) AS lo, max(p) AS hi, bool_and(p IN (0, 0.5, 1)) AS plain, count(*) FILTER (series % 3 <> 0) AS tilted, count(*) FILTER (NOT down) AS hovering, (max(t) FILTER (down) - min(t) FILTER (down)) / 1e6 AS s, sum(id % 4 + 1) FILTER (down) AS pts FROM e GROUP BY kind)
SELECT kind, n, levels, lo, hi, tilted, hovering, CASE WHEN levels = 1 AND lo = 0.5 THEN 'none' WHEN levels <= 2 AND plain THEN 'on-off' WHEN levels >= 8 AND hi - lo > 0.2 THEN 'levels' ELSE 'maybe' END AS verdict,
 round(pts / s, 8) AS per_second, round(pts / greatest(n - hovering, 1), 8) AS points_per_event FROM g""")
def d65_pen_capability(spark, sf):
    """Kinds of events are pointer kinds; one is stuck at the placeholder and one knows three pressures."""
    p = F.when(F.col("kind") == "view", 0.5).when(F.col("kind") == "click", (F.col("id") % 3) / 2).otherwise(F.col("value") / 500)
    s = t.samples(spark, sf).select("kind", p.alias("p"), (F.col("series") % 3).alias("tilt"), (F.col("id") % 5 == 0).alias("hover"), "t", (F.col("id") % 4 + 1).alias("points"))
    return op.pen_capability(s, "kind", "p", "tilt", "hover", "t", "points").withColumns({c: F.round(c, 8) for c in ("per_second", "points_per_event")})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def f1_order_index(spark, sf):
    return op.order_index(t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def f2_order_stats(spark, sf):
    g = t.table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return op.order_stats(g, "total", "o_custkey")


@query(f"""WITH {t.SERIES}, m AS (SELECT render, median(ms) AS m FROM series GROUP BY render), r AS (SELECT *, row_number() OVER (PARTITION BY render ORDER BY ms DESC, pass) AS place FROM series)
SELECT render, pass, ms, place, round(ms / m, 6) AS to_median FROM r JOIN m USING (render) WHERE place <= 5""")
def f3_slowest(spark, sf):
    return rounded(op.slowest(t.series(spark, sf), "render", "ms", ["pass"], 5), 6).select("render", "pass", "ms", "place", "to_median")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def f4_biggest(spark, sf):
    return op.biggest(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 3)


@query(f"""WITH {t.SERIES} SELECT render, pass FROM (SELECT *, count(*) OVER (PARTITION BY render) AS n FROM series) WHERE pass % greatest(1, n // 25) = 0""")
def f5_systematic_sample(spark, sf):
    return op.systematic_sample(t.series(spark, sf), "render", "pass", 25).select("render", "pass")


@query(f"""WITH {t.SERIES}, s AS (SELECT render, pass - 1 AS i, count(*) OVER (PARTITION BY render) AS n FROM series), p AS (SELECT DISTINCT render, (2 * k + 1) * n // (2 * least(25, n)) AS i FROM s, range(25) AS r(k) WHERE k < least(25, n))
SELECT render, i + 1 AS pass FROM p""")
def f5_mid_stratum_sample(spark, sf):
    rows = t.series(spark, sf).withColumn("i", F.col("pass") - 1)
    return op.mid_stratum_sample(rows, "render", "i", 25).select("render", "pass")


@query(f"""WITH {t.SERIES}, j AS (SELECT render, pass, ms - lag(ms) OVER (PARTITION BY render ORDER BY pass) AS jump FROM series) SELECT render, pass, round(jump, 2) AS jump FROM j WHERE jump IS NOT NULL ORDER BY abs(jump) DESC, render, pass LIMIT 4""")
def f6_worst_cells(spark, sf):
    j = F.col("ms") - F.lag("ms").over(Window.partitionBy("render").orderBy("pass"))
    rows = t.series(spark, sf).withColumn("jump", j).filter("jump is not null").select("render", "pass", "jump", F.abs("jump").alias("size"), F.struct("render", "pass").alias("k"))
    return op.biggest(rows, "size", "k", 4).select("render", "pass", F.round("jump", 2).alias("jump"))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_name, p_size // 10 AS score, p_type = 'ECONOMY' AS hero, contains(p_name, 'ring') AS sized FROM part), m AS (SELECT *, max(score) OVER (PARTITION BY p_brand) AS top FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hero DESC, sized DESC, p_partkey) AS place FROM m WHERE score = top) SELECT p_brand, p_partkey, place FROM r WHERE place <= 3""")
def f7_best_candidates(spark, sf):
    items = t.table(spark, sf, "part").select("p_brand", "p_partkey", F.expr("p_size div 10").alias("score"), (F.col("p_type") == "ECONOMY").alias("hero"), F.col("p_name").contains("ring").alias("sized"))
    return op.best_candidates(items, "p_brand", "score", ["hero", "sized"], "p_partkey", 3).select("p_brand", "p_partkey", "place")
