"""Queries over renders and their passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet as op
from . import tables as t
from .registry import query


def rounded(df, digits: int = 4):
    """Doubles to a few digits, so that the order of summation does not show; no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(f"""WITH {t.RENDERS}, {t.PASSES}, s AS (SELECT render, sum(ms) AS honest_ms FROM passes GROUP BY render)
SELECT file, round(honest_ms, 4) AS honest_ms, round(honest_ms / ms, 4) AS ratio, CASE WHEN honest_ms / ms > 1.05 THEN 'resumed'
 WHEN honest_ms / ms < 0.95 THEN 'stalled' ELSE 'whole' END AS verdict, abs(honest_ms / ms - 1) > 0.02 AS off
FROM renders JOIN s ON file = render""")
def d16_resume_stall(spark, sf):
    return rounded(op.resume_stall(t.renders(spark, sf), t.passes(spark, sf)))


@query("""SELECT n, bytes, largest, pixels, text_bytes, round(bytes / text_bytes, 4) AS bytes_per_text_byte FROM
 (SELECT count(*) AS n, round(sum(o_totalprice), 4) AS bytes, max(o_totalprice) AS largest, sum(o_orderkey * 640)::BIGINT AS pixels FROM orders),
 (SELECT sum(strlen(replace(text, chr(13) || chr(10), chr(10))))::BIGINT AS text_bytes FROM documents)""")
def d1_fleet_totals(spark, sf):
    renders = t.table(spark, sf, "orders").select(F.col("o_totalprice").alias("bytes"), (F.col("o_orderkey") * 640).alias("pixels"))
    return rounded(op.fleet_totals(renders, t.table(spark, sf, "documents")))


@query("""SELECT c_mktsegment AS engine, c_nationkey AS arch, count(*) AS n, max(c_custkey) AS widest,
 string_agg(DISTINCT (c_custkey % 3)::VARCHAR, ',' ORDER BY (c_custkey % 3)::VARCHAR) AS tiles FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2""")
def d2_hardware_classes(spark, sf):
    rows = t.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("engine"), F.col("c_nationkey").alias("arch"), "c_custkey", (F.col("c_custkey") % 3).alias("tile"))
    return op.hardware_classes(rows, ["engine", "arch"], "c_custkey", "tile")


@query(f"""WITH {t.RENDERS}, d AS (SELECT DISTINCT at_s, w, engine FROM renders WHERE state <> 'P')
SELECT engine, count(*) AS n, sum(w * 1000000)::BIGINT AS pixels, round(sum(w * 1000000) / 1099511627776, 9) AS share FROM d GROUP BY GROUPING SETS ((engine), ())""")
def d3_render_census(spark, sf):
    rows = t.renders(spark, sf).withColumn("px", F.col("w") * 1_000_000)
    return rounded(op.render_census(rows, ["at_s", "w", "engine"], "px", F.col("state") == "P"), 9)


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS slab, count(*) AS files, sum(l_quantity) AS bytes FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def d4_footprint(spark, sf):
    return op.footprint(t.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "slab"), "slab", "l_quantity")


@query(f"""WITH {t.RENDERS} SELECT file, count(*) OVER (PARTITION BY inputs) = 1 AS only_0, count(*) OVER (PARTITION BY engine, ms) = 1 AS only_1 FROM renders""")
def d5_singletons(spark, sf):
    return op.singletons(t.renders(spark, sf), ["inputs"], ["engine", "ms"]).select("file", "only_0", "only_1")


@query(f"""WITH {t.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY render ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY render) AS c FROM series),
 u AS (SELECT render, ms AS upper_median FROM r WHERE i = c // 2)
SELECT render, count(ms) AS n, min(ms) AS least, max(ms) AS most, any_value(upper_median) AS upper_median, count(*) FILTER (ms > 2 * upper_median) AS slow,
 round(median(ms), 4) AS mid_median FROM series JOIN u USING (render) GROUP BY render""")
def d6_tile_stats(spark, sf):
    return rounded(op.tile_stats(t.series(spark, sf)))


@query(f"""WITH {t.SERIES}, m AS (SELECT render, median(ms) AS m, median(bytes) AS b FROM series GROUP BY render),
 s AS (SELECT render, count(*) AS slow, median(ms) AS sm, median(bytes) AS sb, any_value(m) AS m, any_value(b) AS b FROM series JOIN m USING (render) WHERE ms > 1.8 * m GROUP BY render)
SELECT render, slow, round(sm / m, 4) AS time_ratio, round(sb / b, 4) AS byte_ratio, round((sb / b - 1) / nullif(sm / m - 1, 0), 4) AS carry FROM s""")
def d7_slow_tile_carry(spark, sf):
    return rounded(op.slow_tile_carry(t.series(spark, sf), 1.8))


@query(f"""WITH {t.PASSES} SELECT render, count(*) AS n, CASE WHEN min(ms) < max(ms) AND min(bytes) < max(bytes) THEN round(corr(ms, bytes), 6) END AS r FROM passes GROUP BY render""")
def d8_time_bytes_corr(spark, sf):
    return rounded(op.time_bytes_corr(t.passes(spark, sf)), 6)


@query(f"""WITH {t.SERIES} SELECT render, count(*) AS n, round(regr_slope(ms, bytes), 4) AS slope, round(regr_intercept(ms, bytes), 4) AS intercept,
 round(regr_r2(ms, bytes), 6) AS r2, round(sum(ms) / sum(bytes), 4) AS per_byte, round(regr_intercept(ms, bytes) * count(*) / sum(ms), 6) AS fixed_share FROM series GROUP BY render""")
def d9_cost_split(spark, sf):
    out = op.cost_split(t.series(spark, sf))
    return out.select("render", "n", *[F.round(c, 6 if c in ("r2", "fixed_share") else 4).alias(c) for c in ("slope", "intercept", "r2", "per_byte", "fixed_share")])


@query(f"""WITH {t.RENDERS}, f AS (SELECT engine, sum(ms) / count(*) AS cost, min(ms) AS fixed, min(w) AS tile FROM renders GROUP BY engine)
SELECT engine, rank() OVER (ORDER BY cost DESC) AS rank, round(cost, 4) AS cost, fixed, round((SELECT max(cost) / min(cost) - 1 FROM f), 6) AS spread,
 (SELECT count(DISTINCT tile) > 1 FROM f) AS mixed_tiles FROM f""")
def d10_cost_ranking(spark, sf):
    fits = t.renders(spark, sf).groupBy("engine").agg((F.sum("ms") / F.count("*")).alias("cost"), F.min("ms").alias("fixed"), F.min("w").alias("tile"))
    out = op.cost_ranking(fits, "engine", "cost", "fixed", "tile")
    return out.withColumn("cost", F.round("cost", 4)).withColumn("spread", F.round("spread", 6))


@query(f"""WITH {t.RENDERS} SELECT w, count(DISTINCT inputs) AS pictures, min(ms) AS ms_least, max(ms) AS ms_most, round(max(ms) / min(ms), 4) AS ms_spread
FROM renders GROUP BY w HAVING count(DISTINCT inputs) > 1""")
def d11_spread_at_width(spark, sf):
    return rounded(op.spread_at_width(t.renders(spark, sf), "w", "inputs", "ms"))


@query(f"""WITH {t.PASSES}, o AS (SELECT *, row_number() OVER (PARTITION BY part, bytes ORDER BY render * 100 + pass, worker) AS r FROM passes),
 s AS (SELECT part, ms, ms - lag(ms) OVER (PARTITION BY part ORDER BY bytes) AS d FROM o WHERE r = 1)
SELECT part, count(*) AS rungs, CASE WHEN count(*) FILTER (d > 0) = 0 AND count(*) FILTER (d < 0) > 0 THEN 'falling' WHEN count(*) FILTER (d < 0) = 0
 AND count(*) FILTER (d > 0) > 0 THEN 'rising' WHEN count(*) FILTER (d <> 0) = 0 THEN 'flat' ELSE 'mixed' END AS direction, round(max(ms) / min(ms), 4) AS spread FROM s GROUP BY part""")
def d12_bpp_ladder(spark, sf):
    rows = t.passes(spark, sf).withColumn("o", F.col("render") * 100 + F.col("pass"))
    return rounded(op.bpp_ladder(rows, "part", "bytes", "ms", "o"))


@query(f"""WITH {t.SERIES}, g AS (SELECT render, bytes, avg(ms) AS y FROM series GROUP BY render, bytes),
 s AS (SELECT *, y / lag(y) OVER (PARTITION BY render ORDER BY bytes) AS s FROM g)
SELECT render, round(regr_slope(ln(y), ln(bytes)), 6) AS exponent, round(pow(2.0, regr_slope(ln(y), ln(bytes))), 6) AS per_doubling, round(avg(s), 6) AS mean_ratio,
 round(stddev_samp(s), 6) AS sd_ratio, round(stddev_samp(s) / avg(s), 6) AS relative_spread FROM s GROUP BY render""")
def d13_power_law(spark, sf):
    rows = t.series(spark, sf).groupBy("render", "bytes").agg(F.avg("ms").alias("y"))
    return rounded(op.power_law(rows, "render", "bytes", "y"), 6)


@query(f"""WITH {t.SERIES}, l AS (SELECT *, min(bytes) OVER (PARTITION BY render) AS low FROM series)
SELECT render, round(avg((bytes > 40)::INT), 6) AS saturated, round(avg((bytes = low)::INT), 6) AS at_floor FROM l GROUP BY render""")
def d14_saturated_share(spark, sf):
    return rounded(op.saturated_share(t.series(spark, sf), "bytes", 40), 6)


@query(f"""WITH {t.SERIES} SELECT render, max(ms) AS dearest, round(quantile_cont(ms, 0.9), 3) AS p90, round(median(ms), 3) AS median FROM series GROUP BY render""")
def d15_occupancy_percentiles(spark, sf):
    return rounded(op.occupancy_percentiles(t.series(spark, sf), "ms"), 3)


@query(f"""WITH {t.SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY render) AS n FROM series),
 g AS (SELECT render, sum(ms) FILTER (pass <= n // 2) AS front, sum(ms) FILTER (pass > n // 2) AS back FROM n GROUP BY render)
SELECT render, round(front, 2) AS front, round(back, 2) AS back, round(back / front, 4) AS slowdown FROM g""")
def d17_degradation(spark, sf):
    return op.degradation(t.series(spark, sf)).select("render", F.round("front", 2).alias("front"), F.round("back", 2).alias("back"), F.round("slowdown", 4).alias("slowdown"))


@query(f"""WITH {t.SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY render) AS n FROM series)
SELECT render, (pass - 1) * 10 // n AS tenth, round(sum(ms), 2) AS ms FROM n GROUP BY 1, 2""")
def d17_tenths(spark, sf):
    return rounded(op.tenths(t.series(spark, sf)), 2)


@query(f"""WITH {t.PASSES}, g AS (SELECT worker, count(*) AS passes, sum(ms) AS total, avg(ms) AS mean, max(ms) AS worst FROM passes GROUP BY worker)
SELECT worker, passes, round(total, 2) AS total, round(mean, 2) AS mean, worst, round((SELECT max(mean) / min(mean) FROM g), 2) AS slowest_to_fastest,
 (SELECT max(mean) / min(mean) FROM g) > 1.5 AS uneven FROM g""")
def d20_per_worker(spark, sf):
    return rounded(op.per_worker(t.passes(spark, sf)), 2)


@query("""WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS ms, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
 count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem WHERE l_returnflag IN ('A', 'R')),
 g AS (SELECT k, count(*) AS n, sum(ms) AS paint, avg(ms) AS mean, sum(ms) / 8 AS floor, max(ms) FILTER (i = c * 9 // 10) AS p90, max(ms) FILTER (i = c // 10) AS p10 FROM r GROUP BY k)
SELECT a.n AS n_a, round(a.paint, 2) AS paint_a, round(a.mean, 2) AS mean_a, round(a.floor, 2) AS floor_a, a.p90 AS p90_a, a.p10 AS p10_a, b.n AS n_b, round(b.paint, 2) AS paint_b,
 round(b.mean, 2) AS mean_b, round(b.floor, 2) AS floor_b, b.p90 AS p90_b, b.p10 AS p10_b, round(a.mean / b.mean - 1, 4) AS gain, a.n <> b.n AS mismatch,
 CASE WHEN abs(a.mean / b.mean - 1) > 0.10 THEN 'over 10 %' WHEN abs(a.mean / b.mean - 1) > 0.05 THEN 'over 5 %' ELSE 'none' END AS warn FROM g a, g b WHERE a.k = 'A' AND b.k = 'R'""")
def d22_compare_runs(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("ms"))
    out = op.compare_runs(rows.filter("k = 'A'").select("ms"), rows.filter("k = 'R'").select("ms"), 8)
    return out.select(*[F.round(c, 4 if c == "gain" else 2).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query(f"""WITH {t.RENDERS}, i AS (SELECT inputs, engine, avg(ms) AS m FROM renders GROUP BY inputs, engine)
SELECT inputs, count(*) AS groups, round(min(m), 7) AS least, round(max(m), 7) AS most, round(max(m) / min(m) - 1, 7) AS spread FROM i GROUP BY inputs""")
def d67_mean_by_group_spread(spark, sf):
    out = op.mean_by_group_spread(t.renders(spark, sf), "engine", "inputs", "ms")
    return out.select("inputs", "groups", F.round("least", 7).alias("least"), F.round("most", 7).alias("most"), F.round("spread", 7).alias("spread"))


@query(f"""WITH {t.RENDERS} SELECT w, count(*) AS n, round(median(ms), 3) AS median_size, round(median(ms) / avg(w * 1000), 4) AS of_raw FROM renders WHERE state <> 'P' GROUP BY w""")
def d68_size_ladder(spark, sf):
    out = op.size_ladder(t.renders(spark, sf), "w", "ms", F.col("w") * 1000, F.col("state") == "P")
    return out.select("w", "n", F.round("median_size", 3).alias("median_size"), F.round("of_raw", 4).alias("of_raw"))


@query(f"""WITH {t.PASSES}, g AS (SELECT bytes, flag, avg(ms) AS v FROM passes GROUP BY bytes, flag)
SELECT bytes, round(max(v) FILTER (flag = 'A'), 2) AS "t_A", round(max(v) FILTER (flag = 'N'), 2) AS "t_N", round(max(v) FILTER (flag = 'R'), 2) AS "t_R",
 arg_min(flag, v) AS best, round(100 * (1 - min(v) / max(v)), 2) AS saved FROM g GROUP BY bytes""")
def d69_best_tile(spark, sf):
    return rounded(op.best_tile(t.passes(spark, sf), "bytes", "flag", "ms", ["A", "N", "R"]), 2)


@query(f"""WITH {t.PASSES}, g AS (SELECT 1 AS held, max(ms) / min(ms) - 1 AS s FROM passes GROUP BY bytes HAVING count(*) > 1 UNION ALL
 SELECT 2, max(ms) / min(ms) - 1 FROM passes GROUP BY bytes, flag HAVING count(*) > 1 UNION ALL SELECT 3, max(ms) / min(ms) - 1 FROM passes GROUP BY bytes, flag, worker HAVING count(*) > 1)
SELECT held, count(*) AS groups, round(avg(s), 4) AS spread FROM g GROUP BY held""")
def d70_spread_decomposition(spark, sf):
    return rounded(op.spread_decomposition(t.passes(spark, sf), ["bytes", "flag", "worker"], "ms"))


_TILES = f"""{t.PASSES}, g AS (SELECT flag, bytes, sum(ms) AS ms, count(*) AS n FROM passes GROUP BY flag, bytes)"""


def _tiles(spark, sf):
    return t.passes(spark, sf).groupBy("flag", "bytes").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))


@query(f"""WITH {_TILES}, d AS (SELECT flag, bytes, ms - lag(ms) OVER w AS d_ms, n - lag(n) OVER w AS d_passes FROM g WINDOW w AS (PARTITION BY flag ORDER BY bytes DESC))
SELECT flag, bytes, round(d_ms, 2) AS d_ms, d_passes, round(d_ms / nullif(d_passes, 0), 2) AS ms_per_pass FROM d WHERE d_ms IS NOT NULL""")
def d71_marginal_overhead(spark, sf):
    return rounded(op.marginal_overhead(_tiles(spark, sf), "flag", "bytes", "ms", "n"), 2)


@query(f"""WITH {t.PASSES}, g AS (SELECT flag, bytes, avg(ms) AS ms FROM passes GROUP BY flag, bytes),
 f AS (SELECT flag, regr_intercept(ms, bytes * bytes) AS overhead, regr_slope(ms, bytes * bytes) AS paint FROM g GROUP BY flag)
SELECT flag, bytes, round(overhead, 2) AS overhead, round(paint, 4) AS paint, round(ms - overhead - paint * bytes * bytes, 2) AS residual, round(overhead / ms, 4) AS share FROM g JOIN f USING (flag)""")
def d72_overhead_model(spark, sf):
    rows = t.passes(spark, sf).groupBy("flag", "bytes").agg(F.avg("ms").alias("ms"))
    out = op.overhead_model(rows, "flag", "bytes", "ms")
    return out.select("flag", "bytes", *[F.round(c, d).alias(c) for c, d in (("overhead", 2), ("paint", 4), ("residual", 2), ("share", 4))])


@query(f"""WITH {t.PASSES} SELECT bytes, round(avg(ms) FILTER (flag = 'A'), 2) AS a, round(avg(ms) FILTER (flag = 'R'), 2) AS b,
 round(avg(ms) FILTER (flag = 'R') / avg(ms) FILTER (flag = 'A'), 4) AS gap FROM passes WHERE flag IN ('A', 'R', 'N') GROUP BY bytes""")
def d73_engine_gap(spark, sf):
    out = op.engine_gap(t.passes(spark, sf), ["bytes"], "flag", "ms", "A", "R")
    return out.select("bytes", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("gap", 4).alias("gap"))


@query("""WITH c AS (SELECT c_mktsegment AS material, o_orderpriority AS device, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ms0, avg(c_acctbal) FILTER (o_orderstatus = 'F') AS light0,
 avg(o_totalprice) FILTER (o_orderstatus = 'O') AS ms1, avg(c_acctbal) FILTER (o_orderstatus = 'O') AS light1 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT material, device, round(ms0, 2) AS ms0, round(ms1, 2) AS ms1, round(ms0 / ms1, 4) AS path_ratio, round(ms0 / max(ms0) FILTER (device = '1-URGENT') OVER (PARTITION BY material), 4) AS device_ratio,
 round(abs(light0 - light1), 2) AS light_gap FROM c""")
def d74_path_matrix(spark, sf):
    rows = t.table(spark, sf, "orders").join(t.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("material"), F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("device"), F.col("o_totalprice").alias("ms"), F.col("c_acctbal").alias("light"))
    out = op.path_matrix(rows, "material", "path", "device", "ms", "light", ("F", "O"), "1-URGENT")
    return out.select("material", "device", *[F.round(c, d).alias(c) for c, d in (("ms0", 2), ("ms1", 2), ("path_ratio", 4), ("device_ratio", 4), ("light_gap", 2))])


@query(f"""WITH {t.RENDERS}, g AS (SELECT inputs, engine, avg(ms) AS mean FROM renders GROUP BY 1, 2)
SELECT inputs, engine, round(mean, 7) AS mean, round(100 * (mean / 250000.0 - 1), 7) AS percent_off, round(max(mean) OVER w - min(mean) OVER w, 7) AS range FROM g WINDOW w AS (PARTITION BY inputs)""")
def d75_agreement(spark, sf):
    return rounded(op.agreement(t.renders(spark, sf), "inputs", "engine", "ms", 250000.0), 7)


@query(f"""WITH {t.SERIES}, g AS (SELECT render, flag, avg(bytes) AS v, median(ms) AS median, max(ms) AS slowest FROM series GROUP BY 1, 2)
SELECT a.render, a.flag AS flag_a, round(a.v, 3) AS v_a, round(a.median, 3) AS median_a, a.slowest AS slowest_a, b.flag AS flag_b, round(b.v, 3) AS v_b, round(b.median, 3) AS median_b,
 b.slowest AS slowest_b, round(b.v - a.v, 3) AS delta FROM g a JOIN g b USING (render) WHERE a.flag < b.flag""")
def d76_tile_invariance(spark, sf):
    return rounded(op.tile_invariance(t.series(spark, sf), ["render"], "flag", "bytes", "ms"), 3)


@query("""WITH f AS (SELECT o_orderkey AS k, o_totalprice / 20 AS size FROM orders), i AS (SELECT l_orderkey AS k, sum(l_quantity) AS payload FROM lineitem GROUP BY 1)
SELECT CASE WHEN size < 1000 THEN 'small' WHEN size < 10000 THEN 'middle' ELSE 'large' END AS band, count(*) AS n, round(median(size / payload), 4) AS median_gap FROM f JOIN i USING (k) GROUP BY 1""")
def d77_payload_gap(spark, sf):
    files = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 20).alias("size"))
    index = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("payload"))
    return rounded(op.payload_gap(files, index, "k", "size", "payload"))


@query(f"""WITH {t.PASSES}, g AS (SELECT pass AS level, count(*) AS tiles, sum(bytes) AS bytes FROM passes GROUP BY pass)
SELECT level, tiles, bytes, round(bytes / tiles, 4) AS per_tile, round(bytes / lag(bytes) OVER (ORDER BY level), 4) AS to_above FROM g""")
def d46_level_stats(spark, sf):
    return rounded(op.level_stats(t.passes(spark, sf).withColumnRenamed("pass", "level"), "level", "bytes"))
