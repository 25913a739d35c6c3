"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, raster as op
from . import tables as t
from .fleet import rounded
from .registry import query


def _pair(df, off):
    """Images numbered by pairs: 2 p and 2 p + 1."""
    return df.filter(F.col("image") % 2 == off).withColumn("pair", F.expr("image div 2"))


@query(f"""WITH {t.PIXELS}, d AS (SELECT a.image // 2 AS pair, (a.v - b.v) * 10 AS d FROM pixels a JOIN pixels b ON a.image % 2 = 0 AND b.image = a.image + 1 AND a.x = b.x AND a.y = b.y)
SELECT pair, round(avg(abs(d)), 6) AS mean, round(max(abs(d)), 6) AS most, round(100 * avg((abs(d) > 1)::INT), 6) AS over_1, round(stddev_pop(d), 6) AS sd FROM d GROUP BY pair""")
def d37_image_diff(spark, sf):
    p = t.pixels(spark, sf).withColumn("v", F.col("v") * 10)
    pick = lambda off: _pair(p, off).select("pair", "x", "y", "v")
    return rounded(op.image_diff(pick(0), pick(1), 8, 8)[0], 6)


@query(f"""WITH {t.PIXELS}, d AS (SELECT a.image // 2 AS pair, a.x, a.y, abs(a.v - b.v) AS d FROM pixels a JOIN pixels b ON a.image % 2 = 0 AND b.image = a.image + 1 AND a.x = b.x AND a.y = b.y)
SELECT pair, least(3, x * 4 // 8)::BIGINT AS cx, least(3, y * 4 // 8)::BIGINT AS cy, round(avg(d), 6) AS mean FROM d GROUP BY 1, 2, 3""")
def d37_image_diff_map(spark, sf):
    p = t.pixels(spark, sf)
    pick = lambda off: _pair(p, off).select("pair", "x", "y", "v")
    return rounded(op.image_diff(pick(0), pick(1), 8, 8, 4)[1].withColumns({"cx": F.col("cx").cast("long"), "cy": F.col("cy").cast("long")}), 6)


@query(f"""WITH {t.LEVELS}, d AS (SELECT a.image // 2 AS pair, a.y * 8 + a.x AS i, abs(a.q - b.q) AS d FROM levels a JOIN levels b ON a.image % 2 = 0 AND b.image = a.image + 1 AND a.x = b.x AND a.y = b.y),
 g AS (SELECT pair, CASE WHEN d >= 64 THEN 64 WHEN d >= 32 THEN 32 WHEN d >= 16 THEN 16 WHEN d >= 8 THEN 8 WHEN d >= 4 THEN 4 WHEN d >= 2 THEN 2 ELSE d END AS bucket, count(*) AS n FROM d GROUP BY 1, 2),
 c AS (SELECT pair, round(avg(d), 6) AS mean_changed, min(i) AS first_changed FROM d WHERE d > 0 GROUP BY 1) SELECT * FROM g LEFT JOIN c USING (pair)""")
def d38_diff_histogram(spark, sf):
    q = t.levels(spark, sf).withColumn("i", F.col("y") * 8 + F.col("x"))
    a, b = _pair(q, 0).select("pair", "i", F.col("q").alias("a")), _pair(q, 1).select("pair", "i", F.col("q").alias("b"))
    return rounded(op.diff_histogram(a.join(b, ["pair", "i"])), 6)


@query(f"""WITH {t.LEVELS}, {t.CRC_TABLE}, g AS (SELECT image, avg(q) AS mean, min(q) AS lo, max(q) AS hi, min(q) = max(q) AS flat, list(q ORDER BY y, x) AS b FROM levels GROUP BY image)
SELECT image, mean, lo, hi, {t.crc_sql("b")} AS crc, flat FROM g, crc_table""")
def d39_tile_checksums(spark, sf):
    return op.tile_checksums(t.levels(spark, sf), ["y", "x"])


@query(f"""WITH {t.LEVELS}, z AS (SELECT image, x, y, x // 4 AS tx, y // 4 AS ty, CASE WHEN image % 6 IN (0, 1) AND x < 4 THEN 7 ELSE q END AS q FROM levels),
 s AS (SELECT * FROM z WHERE image % 10 <> 1 UNION ALL SELECT image + 1, x, y, tx, ty, q + (y % 4 = 0 AND x % 2 = 0)::INT FROM z WHERE image % 10 = 0), h AS (SELECT image, tx, ty, string_agg(q::VARCHAR, ',' ORDER BY y, x) AS hash FROM s GROUP BY ALL),
 p AS (SELECT a.image // 2 AS pair, tx, ty, a.image AS a, b.image AS b, a.hash = b.hash AS same FROM h a JOIN h b USING (tx, ty) WHERE a.image % 2 = 0 AND b.image = a.image + 1),
 w AS (SELECT pair, bool_and(same) AS same, count(*) FILTER (NOT same) AS tiles FROM p GROUP BY pair),
 d AS (SELECT p.pair, count(*) AS differ, min(x.y * 8 + x.x) AS first, max(abs(x.q - y.q)) AS worst, bool_and(abs(x.q - y.q) = 1 AND x.y % 4 = 0) AS mark_shaped FROM (SELECT DISTINCT pair, a, b FROM p) p JOIN s x ON x.image = p.a JOIN s y ON y.image = p.b AND x.x = y.x AND x.y = y.y WHERE x.q <> y.q GROUP BY 1)
SELECT pair, same, tiles, coalesce(differ, 0) AS differ, first, worst, coalesce(mark_shaped, false) AS mark_shaped FROM w LEFT JOIN d USING (pair)""")
def d40_same_picture(spark, sf):
    """Neighbouring images are pairs. Some share their left half, and the second of every fifth pair is the first one with marks: one more at every
    second pixel of every fourth row."""
    q = t.levels(spark, sf).withColumn("q", F.when((F.col("image") % 6 < 2) & (F.col("x") < 4), 7).otherwise(F.col("q")))
    q = q.withColumns({"tx": F.expr("x div 4"), "ty": F.expr("y div 4")}).select("image", "x", "y", "tx", "ty", "q")
    marked = q.filter("image % 10 = 0").withColumns({"image": F.col("image") + 1, "q": F.col("q") + ((F.col("y") % 4 == 0) & (F.col("x") % 2 == 0)).cast("int")})
    q = q.filter("image % 10 <> 1").unionByName(marked)
    e = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"))
    pairs = e.filter("a % 2 = 0").withColumn("b", F.col("a") + 1).join(e.select(F.col("a").alias("b")), "b", "left_semi").select(F.expr("a div 2").alias("pair"), "a", "b")
    return op.same_picture(pairs, op.tile_hashes(q, "ty", "tx"), q, ["ty", "tx"], 8, F.col("y") % 4 == 0)


@query(f"""WITH {t.LEVELS}, g AS (SELECT image, count(*) AS n, count(*) <> 64 AS wrong_size, NOT bool_or(q <> 0) AS never_drawn, avg(q) FILTER ((y * 8 + x) % 5 = 0) AS mean, avg((q > 40)::INT) FILTER ((y * 8 + x) % 5 = 0) AS lit40 FROM levels GROUP BY image)
SELECT image, n, wrong_size, never_drawn, round(mean, 6) AS mean, round(lit40, 6) AS lit40, abs(mean - label * 4) > 0.5 AS mismatch FROM g JOIN embeddings ON vec_id = image""")
def d41_tile_audit(spark, sf):
    q = t.levels(spark, sf)
    recorded = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), (F.col("label") * 4).alias("recorded"))
    return rounded(op.tile_audit(q, 64, recorded, 8, 5), 6)


@query(f"""WITH {t.PIXELS}, r AS (SELECT *, v - avg(v) OVER (PARTITION BY image, x // 2, y // 2) AS r FROM pixels)
SELECT image, round(avg(abs(r)), 6) AS mean_lost, round(max(abs(r)), 6) AS most_lost, round(avg((abs(r) > 0.1)::INT), 6) AS over, round(var_pop(r) / var_pop(v), 6) AS variance_lost FROM r GROUP BY image""")
def d42_detail_above(spark, sf):
    return rounded(op.detail_above(t.pixels(spark, sf), 2), 6)


@query(f"""WITH {t.PIXELS} SELECT image, x // 2 AS cx, y // 2 AS cy, round(avg(v), 6) AS v FROM pixels WHERE x BETWEEN 0 AND 7 AND y BETWEEN 4 AND 7 GROUP BY 1, 2, 3""")
def d43_thumbnail(spark, sf):
    return rounded(op.thumbnail(t.pixels(spark, sf), 2, 4, (1, 4, 6, 7)), 6)


_ALPHA = t.LEVELS + ", px AS (SELECT image, x, y, q, CASE WHEN (x + y + image) % 3 = 0 THEN 0 ELSE 255 - q END AS a FROM levels WHERE NOT (x = 7 AND image % 4 = 0))"


def alpha(spark, sf):
    q = t.levels(spark, sf).filter("not (x = 7 and image % 4 = 0)")
    return q.select("image", "x", "y", "q", F.when((F.col("x") + F.col("y") + F.col("image")) % 3 == 0, 0).otherwise(255 - F.col("q")).alias("a"))


def _level(src, dst):
    return f"""{dst} AS (SELECT image, x // 2 AS x, y // 2 AS y, (CASE WHEN sum(a) > 0 THEN (2 * sum(q * a) + sum(a)) // (2 * sum(a)) ELSE 0 END)::INT AS q, ((sum(a) + 2) // 4)::INT AS a FROM {src} GROUP BY 1, 2, 3)"""


@query(f"WITH {_ALPHA}, {_level('px', 'l1')} SELECT * FROM l1")
def d44_pyramid_level(spark, sf):
    return op.pyramid_level(alpha(spark, sf))


@query(f"WITH {_ALPHA}, {_level('px', 'l1')}, {_level('l1', 'l2')}, {_level('l2', 'l3')} SELECT *, 1 AS level FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3")
def d45_pyramid(spark, sf):
    return op.pyramid(alpha(spark, sf), 8, 1)


_COLS = t.SERIES + ", cols AS (SELECT render, pass - 1 AS x, ms / 1000 + CASE WHEN (pass - 1) // 64 % 2 = 1 THEN 30 ELSE 0 END AS v FROM series)"


def columns(spark, sf):
    return t.series(spark, sf).select("render", (F.col("pass") - 1).alias("x"), (F.col("ms") / 1000 + F.when(F.expr("(pass - 1) div 64") % 2 == 1, 30).otherwise(0)).alias("v"))


_STEP = _COLS + """, js AS (SELECT render, unnest(range(32, max(x) + 1, 32)) AS j FROM cols GROUP BY render),
 near AS (SELECT c.render, j, x - j + 0.5 AS d, v, x < j AS l FROM cols c JOIN js ON c.render = js.render AND x >= j - 16 AND x < j + 16),
 st AS (SELECT render, j, regr_intercept(v, d) FILTER (NOT l) - regr_intercept(v, d) FILTER (l) AS step, j % 64 = 0 AS is_join FROM near GROUP BY render, j HAVING count(*) FILTER (l) = 16 AND count(*) FILTER (NOT l) = 16)"""


@query(f"WITH {_STEP} SELECT render, j, round(step, 5) AS step, is_join FROM st")
def d47_seam_step(spark, sf):
    return rounded(op.seam_step(columns(spark, sf), "render", 64, 16), 5)


@query(f"""WITH {_STEP}, g AS (SELECT render, avg(abs(step)) FILTER (is_join) AS at_joins, avg(abs(step)) FILTER (NOT is_join) AS at_control, stddev_samp(abs(step)) FILTER (NOT is_join) AS sd FROM st GROUP BY render), z AS (SELECT *, (at_joins - at_control) / nullif(sd, 0) AS z FROM g)
SELECT render, round(at_joins, 5) AS at_joins, round(at_control, 5) AS at_control, round(sd, 5) AS sd, round(z, 5) AS z, CASE WHEN z IS NULL THEN 'inconclusive' WHEN z > 3 THEN 'seam' ELSE 'clean' END AS verdict FROM z""")
def d47_seam_verdict(spark, sf):
    return rounded(op.seam_verdict(op.seam_step(columns(spark, sf), "render", 64, 16), "render"), 5)


@query(f"""WITH {_COLS}, k AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY render ORDER BY x)) AS jump FROM cols), g AS (SELECT render, median(jump) FILTER (x % 64 = 0) AS joins, median(jump) FILTER (x % 64 <> 0 AND x % 2 = 0) AS control,
 count(*) FILTER (x % 64 = 0) AS n_joins, count(*) FILTER (x % 64 <> 0 AND x % 2 = 0) AS n_control FROM k WHERE jump IS NOT NULL GROUP BY render)
SELECT render, round(joins, 7) AS joins, round(control, 7) AS control, n_joins, n_control, CASE WHEN n_joins < 4 OR n_control < 20 THEN 'skip' WHEN control = 0 THEN 'inconclusive' WHEN joins > 3 * control AND joins - control > 0.1 THEN 'rough' ELSE 'smooth' END AS verdict FROM g""")
def d48_seam_roughness(spark, sf):
    return rounded(op.seam_roughness(columns(spark, sf), "render", 64), 7)


@query(f"""WITH {t.PIXELS}, a AS (SELECT image // 2 AS pair, x, y, greatest(v, 0) AS ma FROM pixels WHERE image % 2 = 0), b AS (SELECT image // 2 AS pair, x, y, greatest(v, 0) AS mb FROM pixels WHERE image % 2 = 1)
SELECT pair, round(coalesce(sum(least(coalesce(ma, 0), coalesce(mb, 0))) / nullif(sum(greatest(coalesce(ma, 0), coalesce(mb, 0))), 0), 1), 6) AS iou FROM a FULL JOIN b USING (pair, x, y) GROUP BY pair""")
def d49_mask_iou(spark, sf):
    m = t.pixels(spark, sf).withColumn("m", F.greatest(F.col("v"), F.lit(0.0)))
    return rounded(op.mask_iou(_pair(m, 0).select("pair", "x", "y", "m"), _pair(m, 1).select("pair", "x", "y", "m")), 6)


_MASK = t.PIXELS + ", mask AS (SELECT image, x, y, CASE WHEN v > 0.05 THEN v ELSE 0 END AS m, v FROM pixels)"


def masks(spark, sf):
    return t.pixels(spark, sf).select("image", "x", "y", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0).alias("m"), "v")


@query(f"""WITH {_MASK}, b AS (SELECT image, x, y, CASE WHEN v > 0.2 THEN 1 ELSE 0 END AS b FROM mask), d AS (SELECT a.image, a.x, a.y, max(b.b) AS b FROM b a JOIN b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3),
 s AS (SELECT m.image, m.m, r.m AS shifted, d.b FROM mask m JOIN mask r ON r.image = m.image AND (r.x + 3) % 8 = m.x AND (r.y + 2) % 8 = m.y JOIN d ON d.image = m.image AND d.x = m.x AND d.y = m.y)
SELECT image, round(sum(CASE WHEN b > 0 THEN m ELSE 0 END) / nullif(sum(m), 0), 6) AS inside, round(sum(CASE WHEN b > 0 THEN shifted ELSE 0 END) / nullif(sum(shifted), 0), 6) AS control FROM s GROUP BY image""")
def d50_containment_vs_shift(spark, sf):
    m = masks(spark, sf)
    base = m.select("image", "x", "y", (F.col("v") > 0.2).cast("int").alias("m"))
    return rounded(op.containment_vs_shift(m.select("image", "x", "y", "m"), base, 1, 3, 2, 8, 8), 6)


@query(f"""WITH {t.PIXELS}, s AS (SELECT p.image, p.x, p.y, p.v, r.v AS shifted, CASE WHEN p.v > 0.1 OR (p.x + p.y) % 5 = 0 THEN 1.0 ELSE 0.2 END AS m FROM pixels p JOIN pixels r ON r.image = p.image AND (r.x + 3) % 8 = p.x AND (r.y + 2) % 8 = p.y),
 l AS (SELECT image, median(v) FILTER (m < 0.5) AS g, quantile_cont(v, 0.9) FILTER (m >= 0.5) AS w FROM s GROUP BY image), q AS (SELECT image, v, shifted, g * (1 - m) + w * m AS p FROM s JOIN l USING (image))
SELECT image, round(corr(p, v), 6) AS aligned, round(corr(p, shifted), 6) AS control, round(corr(p, v) - corr(p, shifted), 6) AS gain FROM q GROUP BY image""")
def d51_stack_verify(spark, sf):
    p = t.pixels(spark, sf).select("image", "x", "y", "v")
    one = p.select("image", "x", "y", F.lit("major").alias("tier"), F.when(F.col("v") > 0.1, 1.0).otherwise(0.2).alias("m"))
    two = p.select("image", "x", "y", F.lit("micro").alias("tier"), F.when((F.col("x") + F.col("y")) % 5 == 0, 1.0).otherwise(0.0).alias("m"))
    return rounded(op.stack_verify(one.unionByName(two), p, 3, 2, 8, 8), 6)


_GRAD = t.PIXELS + """, s AS (SELECT *, lead(v) OVER r - lag(v) OVER r AS d, lag(v) OVER r + 2 * v + lead(v) OVER r AS e FROM pixels WINDOW r AS (PARTITION BY image, y ORDER BY x)),
 gr AS (SELECT image, x, y, lag(d) OVER c + 2 * d + lead(d) OVER c AS gx, lead(e) OVER c - lag(e) OVER c AS gy FROM s WINDOW c AS (PARTITION BY image, x ORDER BY y)), g AS (SELECT * FROM gr WHERE gx IS NOT NULL AND gy IS NOT NULL)"""


DIRECTIONS = _GRAD + """, m AS (SELECT image, sqrt(gx * gx + gy * gy) AS mag, 2 * atan2(gy, gx) AS a FROM g), c AS (SELECT image, quantile_cont(mag, 0.5) AS cut FROM m GROUP BY image),
 directions AS (SELECT image, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 0 ELSE sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) END, 6) AS resultant FROM m JOIN c USING (image) WHERE mag >= cut GROUP BY image)"""


@query(f"WITH {DIRECTIONS} SELECT * FROM directions")
def d52_orientation(spark, sf):
    return rounded(op.orientation(t.pixels(spark, sf), 0.5, 10), 6)


@query(f"""WITH {_GRAD}, k AS (SELECT image, x // 4 AS cx, y // 4 AS cy, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM g GROUP BY 1, 2, 3)
SELECT image, cx, cy, round(atan2(2 * xy, xx - yy) / 2, 6) AS angle, round(sqrt(pow(xx - yy, 2) + pow(2 * xy, 2)) / nullif(xx + yy, 0), 6) AS coherence FROM k""")
def d53_direction_grid(spark, sf):
    return rounded(op.direction_grid(t.pixels(spark, sf), 4), 6)


_MIRROR = """lr AS (SELECT a.image, corr(a.v, b.v) AS left_right FROM pixels a JOIN pixels b ON a.image = b.image AND a.y = b.y AND b.x = 7 - a.x WHERE a.x < 4 GROUP BY 1),
 tb AS (SELECT a.image, corr(a.v, b.v) AS top_bottom FROM pixels a JOIN pixels b ON a.image = b.image AND a.x = b.x AND b.y = 7 - a.y WHERE a.y < 4 GROUP BY 1)"""
_CLIP = """lp AS (SELECT *, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM pixels WINDOW r AS (PARTITION BY image, y ORDER BY x), c AS (PARTITION BY image, x ORDER BY y)),
 cl AS (SELECT image, avg((abs(lap) < 0.3 AND (v <= -0.1 OR v >= 0.1))::INT) AS clipped, avg((abs(lap) < 0.3 AND v > 0.05)::INT) AS specular FROM lp WHERE lap IS NOT NULL GROUP BY image)"""
_BLOCK = """st AS (SELECT image, x, abs(v - lag(v) OVER (PARTITION BY image, y ORDER BY x)) AS d FROM pixels), bl AS (SELECT image, avg(d) FILTER (x % 4 = 0) / nullif(avg(d) FILTER (x % 4 <> 0), 0) AS blockiness FROM st WHERE d IS NOT NULL GROUP BY image)"""


@query(f"WITH {t.PIXELS}, {_MIRROR} SELECT image, round(left_right, 6) AS left_right, round(top_bottom, 6) AS top_bottom FROM lr JOIN tb USING (image)")
def d59_mirror_score(spark, sf):
    return rounded(op.mirror_score(t.pixels(spark, sf), 8, 8), 6)


@query(f"WITH {t.PIXELS}, {_CLIP} SELECT image, round(clipped, 6) AS clipped, round(specular, 6) AS specular FROM cl")
def d60_clip_share(spark, sf):
    return rounded(op.clip_share(t.pixels(spark, sf), -0.1, 0.1, 0.05, 0.3), 6)


@query(f"WITH {t.PIXELS}, {_BLOCK} SELECT image, round(blockiness, 6) AS blockiness FROM bl")
def d61_blockiness(spark, sf):
    return rounded(op.blockiness(t.pixels(spark, sf), 4), 6)


@query(f"""WITH {t.PIXELS}, {_MIRROR}, {_CLIP}, {_BLOCK}, n AS (SELECT image, count(*) AS pixels FROM pixels GROUP BY image)
SELECT image, concat_ws(',', CASE WHEN greatest(left_right, top_bottom) > 0.15 THEN 'mirrored' END, CASE WHEN clipped > 0.2 THEN 'clipped' END, CASE WHEN blockiness > 1.1 THEN 'blocky' END, CASE WHEN pixels < 64 THEN 'small' END) AS notes
FROM n LEFT JOIN lr USING (image) LEFT JOIN tb USING (image) LEFT JOIN cl USING (image) LEFT JOIN bl USING (image)""")
def d62_screen_images(spark, sf):
    p = t.pixels(spark, sf)
    size = p.groupBy("image").agg(F.count("*").alias("pixels"))
    return op.screen_images(op.mirror_score(p, 8, 8), op.clip_share(p, -0.1, 0.1, 0.05, 0.3), op.blockiness(p, 4), size, {"mirror": 0.15, "clip": 0.2, "block": 1.1, "pixels": 64})


@query(f"""WITH {t.PIXELS}, s AS (SELECT image, v, (x + y) % 3 = 0 AS i FROM pixels), l AS (SELECT image, median(v) FILTER (NOT i) AS g, quantile_cont(v, 0.01) FILTER (i) AS p1, quantile_cont(v, 0.99) FILTER (i) AS p99, avg(v) FILTER (i) AS mi FROM s GROUP BY image),
 n AS (SELECT image, (v - g) / nullif((CASE WHEN mi >= g THEN p99 ELSE p1 END) - g, 0) AS raw FROM s JOIN l USING (image)), c AS (SELECT *, least(1, greatest(0, raw)) AS n FROM n)
SELECT image, round(avg((raw < 0)::INT), 6) AS below, round(avg((raw > 1)::INT), 6) AS above, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 6) AS iqr FROM c GROUP BY image""")
def d63_value_normalise(spark, sf):
    p = t.pixels(spark, sf).select("image", "x", "y", "v")
    return rounded(op.value_normalise(p, p.select("image", "x", "y", F.when((F.col("x") + F.col("y")) % 3 == 0, 1.0).otherwise(0.0).alias("m"))), 6)


@query(f"""WITH {t.PIXELS}, f AS (SELECT image, v - avg(v) OVER (PARTITION BY image, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM pixels), m AS (SELECT image, median(f) AS m FROM f GROUP BY image)
SELECT image, round(1.4826 * median(abs(f - m)), 6) AS scale, sign(avg(pow(f - mu, 3)))::INT AS polarity FROM f JOIN m USING (image) JOIN (SELECT image, avg(f) AS mu FROM f GROUP BY image) USING (image) GROUP BY image""")
def d64_polarity(spark, sf):
    return rounded(op.polarity(t.pixels(spark, sf), 2), 6)


@query(f"""WITH {t.PIXELS}, r AS (SELECT a.image, a.x AS tx, a.y AS ty, b.v, row_number() OVER (PARTITION BY a.image, a.x, a.y ORDER BY b.v) - 1 AS i, count(*) OVER (PARTITION BY a.image, a.x, a.y) AS n
 FROM pixels a JOIN pixels b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) SELECT image, tx, ty, v FROM r WHERE i = n // 2""")
def w10_smooth_median3x3(spark, sf):
    return op.smooth_median3x3(t.pixels(spark, sf).select("image", F.col("x").alias("tx"), F.col("y").alias("ty"), "v"))


def sheets(spark, sf):
    """Nine rasters of 8 x 8 as one sheet of 24 x 24 cells; the last may be partly empty."""
    at = F.col("image") % 9
    return t.pixels(spark, sf).select(F.expr("image div 9").alias("image"), (at % 3 * 8 + F.col("x")).alias("tx"), (F.floor(at / 3) * 8 + F.col("y")).alias("ty"), "v")


@query(f"""WITH {t.PIXELS}, sheet AS (SELECT image // 9 AS image, image % 9 % 3 * 8 + x AS tx, image % 9 // 3 * 8 + y AS ty, v FROM pixels),
 near AS (SELECT a.image, a.tx, a.ty, b.v, row_number() OVER (PARTITION BY a.image, a.tx, a.ty ORDER BY b.v) - 1 AS i, count(*) OVER (PARTITION BY a.image, a.tx, a.ty) AS n FROM sheet a JOIN sheet b ON a.image = b.image AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1),
 size AS (SELECT image, max(tx) + 1 AS w, max(ty) + 1 AS h, greatest(3, floor((max(tx) + 1) * 0.04 + 0.5)) AS least, floor((max(tx) + 1) * 0.45 + 0.5) AS most FROM sheet GROUP BY image),
 cell AS (SELECT g.image, g.x, g.y, coalesce(v, 0) AS v FROM (SELECT image, x, unnest(range(h)) AS y FROM (SELECT image, h, unnest(range(w)) AS x FROM size)) g LEFT JOIN (SELECT * FROM near WHERE i = n // 2) f ON f.image = g.image AND tx = x AND ty = y),
 ring AS (SELECT c.image, c.x AS cx, c.y AS cy, floor(sqrt((o.x - c.x) ** 2 + (o.y - c.y) ** 2))::INT AS d, count(*) AS n, sum(o.v) AS s, sum(o.v * o.v) AS ss FROM cell c JOIN cell o USING (image) GROUP BY ALL),
 r AS (SELECT *, least_r AS r, least(most, least_r + greatest(4, least_r // 2)) AS far FROM (SELECT image, w, h, most, unnest(range(least::INT, most::INT - 5)) AS least_r FROM size)),
 k AS (SELECT image, w, h, cx, cy, r, sum(n) FILTER (d <= r) AS n_in, sum(s) FILTER (d <= r) AS s_in, sum(n) FILTER (d BETWEEN r + 2 AND far) AS n_out, sum(s) FILTER (d BETWEEN r + 2 AND far) AS s_out, sum(ss) FILTER (d BETWEEN r + 2 AND far) AS ss_out FROM ring JOIN r USING (image) GROUP BY ALL),
 z AS (SELECT *, (s_in / n_in - s_out / n_out) / sqrt((ss_out - s_out * s_out / n_out) / (n_out - 1)) AS z FROM k WHERE n_in >= 24 AND n_out >= 48),
 best AS (SELECT image, image // 2 AS pair, cx::INT AS cx, cy::INT AS cy, r, z, least(cx, w - 1 - cx, cy, h - 1 - cy)::INT AS edge FROM z QUALIFY row_number() OVER (PARTITION BY image ORDER BY z DESC, cy, cx, r) = 1)
SELECT a.image, a.pair, a.cx, a.cy, a.r::INT AS r, round(a.z, 6) AS z, a.edge, round(b.z, 6) AS control_z, round(a.z / b.z, 6) AS to_control,
 CASE WHEN a.edge <= 1 THEN 'at the edge' WHEN b.z IS NULL THEN 'unproven' WHEN a.z / b.z < 1.8 THEN 'too close' ELSE 'separated' END AS verdict
FROM best a LEFT JOIN (SELECT * FROM best WHERE image % 2 = 1) b USING (pair) WHERE a.image % 2 = 0""")
def w11_radial_step(spark, sf):
    """Every other sheet is a target, the one after it its control."""
    fits = op.radial_step(op.smooth_median3x3(sheets(spark, sf))).withColumn("pair", F.expr("image div 2"))
    return rounded(op.radial_verdict(fits.filter("image % 2 = 0"), fits.filter("image % 2 = 1")), 6)


@query(f"""WITH {t.PIXELS}, l AS (SELECT image, x // 2 AS lx, y // 2 AS ly, max(v) AS large_v FROM pixels GROUP BY 1, 2, 3)
SELECT image, x AS tx, y AS ty, lx, ly, v, large_v FROM pixels JOIN l USING (image) WHERE x // 2 = lx AND y // 2 = ly""")
def c9_align_tilings(spark, sf):
    small = t.pixels(spark, sf).select("image", F.col("x").alias("tx"), F.col("y").alias("ty"), "v")
    large = small.groupBy("image", F.floor(F.col("tx") / 2).alias("tx"), F.floor(F.col("ty") / 2).alias("ty")).agg(F.max("v").alias("v"))
    return joins.align_tilings(small, large, 2).filter("refused is null").select("image", "tx", "ty", "lx", "ly", "v", "large_v")


@query(f"""WITH {t.PIXELS} SELECT p.image, p.x, p.y, p.v, r.v AS shifted FROM pixels p JOIN pixels r ON r.image = p.image AND (r.x + 5) % 8 = p.x AND (r.y + 1) % 8 = p.y""")
def c17_shifted_control_join(spark, sf):
    return joins.shifted_control_join(t.pixels(spark, sf).select("image", "x", "y", "v"), 5, 1, 8, 8)
