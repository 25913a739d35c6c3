"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fleet, sequence as op
from . import tables as t
from .fleet import rounded
from .registry import query
from .timing import busy, _BUSY


@query(f"""WITH {t.RENDERS}, p AS (SELECT file, at_s, (ms * 100)::BIGINT AS px FROM renders), r AS (SELECT *, sum(px) OVER (ORDER BY at_s, file) AS total FROM p)
SELECT file, total::BIGINT AS total, unnest(range(((total - px) // 1000000000)::BIGINT + 1, (total // 1000000000)::BIGINT + 1)) AS n FROM r""")
def w1_crossings(spark, sf):
    rows = t.renders(spark, sf).select("file", "at_s", F.round(F.col("ms") * 100).cast("long").alias("px"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return op.crossings(rows, ["at_s", "file"], "px", 1_000_000_000, parts).select("file", "total", "n")


@query(f"""WITH {t.PASSES} SELECT render, pass, round(1e9 - sum(ms) OVER (PARTITION BY render) + sum(ms) OVER (PARTITION BY render ORDER BY pass), 2) AS end_at FROM passes""")
def w2_tile_end_times(spark, sf):
    return op.tile_end_times(t.passes(spark, sf).withColumn("e", F.lit(1e9)), "render", "pass", "ms", "e").select("render", "pass", F.round("end_at", 2).alias("end_at"))


_TRACE = t.SAMPLES + ", tr AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS i, t, (value * 1000000)::BIGINT AS d FROM samples), trace AS (SELECT * FROM tr WHERE i % 5 <> 3)"


def trace(spark, sf):
    w = Window.partitionBy("series").orderBy("t")
    return t.samples(spark, sf).select("series", F.row_number().over(w).cast("long").alias("i"), "t", F.round(F.col("value") * 1_000_000).cast("long").alias("d")).filter("i % 5 <> 3")


@query(f"""WITH {_TRACE}, l AS (SELECT *, lag(t + d) OVER w AS t0, lag(i) OVER w AS b FROM trace WINDOW w AS (PARTITION BY series ORDER BY i)), k AS (SELECT *, t - t0 AS wait FROM l WHERE b = i - 1 AND i > 4),
 m AS (SELECT series, median(wait) AS m FROM k GROUP BY series) SELECT series, i, t0, t AS t1, wait FROM k JOIN m USING (series) WHERE wait > 3 * m""")
def w4_wait_windows(spark, sf):
    """The trace leaves out one of every five passes, as kept traces do, so that gaps occur."""
    return op.wait_windows(trace(spark, sf), "series", "i", "t", "d", 4).select("series", "i", "t0", "t1", "wait")


@query(f"""WITH {_BUSY}, f AS (SELECT *, min(seq) FILTER (b >= 8) OVER (PARTITION BY series) AS full_at FROM busy)
SELECT series, count(*) FILTER (full_at IS NULL OR seq < full_at) AS samples, coalesce(sum((8 - b) * 500) FILTER (full_at IS NULL OR seq < full_at), 0)::BIGINT AS idle FROM f GROUP BY series""")
def w5_warm_up(spark, sf):
    """All samples as a grid of busy workers."""
    return op.warm_up(busy(spark, sf), "series", 8, 500)


@query(f"""WITH {_TRACE}, k AS (SELECT * FROM trace WHERE i > 4 AND (series % 3 > 0 OR i < 40)), n AS (SELECT series, count(*) AS n FROM samples GROUP BY series)
SELECT series, count(*) AS rows, min(i) AS first, max(i) AS last, CASE WHEN count(*) > 1 THEN round((max(i) - min(i)) / (count(*) - 1), 6) END AS stride, (max(i) - min(i) + 1) / any_value(n) < 0.9 AS window_only FROM k JOIN n USING (series) GROUP BY series""")
def w6_trace_coverage(spark, sf):
    """The trace leaves out its first passes, and for every third series those after 40, as kept traces do."""
    total = t.samples(spark, sf).groupBy("series").agg(F.count("*").alias("n"))
    return rounded(op.trace_coverage(trace(spark, sf).filter("i > 4 and (series % 3 > 0 or i < 40)"), "series", "i", total), 6)


@query(f"""WITH {t.SAMPLES}, c AS (SELECT series, kind, CASE kind WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 END AS r FROM samples GROUP BY series, kind HAVING count(*) > 12),
 p AS (SELECT series, arg_min(kind, r) AS kind FROM c WHERE r IS NOT NULL GROUP BY series), g AS (SELECT series, kind, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM samples JOIN p USING (series, kind))
SELECT series, kind, count(*) AS n, round(quantile_cont(gap, 0.5), 1) AS p50, round(quantile_cont(gap, 0.95), 1) AS p95, max(gap) AS most, min(gap) FILTER (gap > 0) AS step FROM g WHERE gap < 172800000000 GROUP BY series, kind""")
def w7_intervals(spark, sf):
    return rounded(op.intervals(t.samples(spark, sf), "series", "kind", "t", 172_800_000_000, ["signup", "error", "click"], 12), 1)


_POINTS = t.SAMPLES + ", pts AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS seq, t / 3.6e9 - 473000 AS h, value AS x, (id % 97)::DOUBLE AS y FROM samples)"


def points(spark, sf):
    w = Window.partitionBy("series").orderBy("t")
    return t.samples(spark, sf).select("series", F.row_number().over(w).cast("long").alias("seq"), (F.col("t") / 3.6e9 - 473000).alias("h"), F.col("value").alias("x"), (F.col("id") % 97).cast("double").alias("y"))


@query(f"""WITH {_POINTS}, m AS (SELECT *, max(h) OVER (PARTITION BY series ORDER BY seq) AS tm FROM pts),
 e AS (SELECT *, first_value(tm) OVER n AS ta, first_value(x) OVER n AS xa, first_value(y) OVER n AS ya, last_value(tm) OVER n AS tb, last_value(x) OVER n AS xb, last_value(y) OVER n AS yb FROM m WINDOW n AS (PARTITION BY series ORDER BY tm RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
 v AS (SELECT *, CASE WHEN tb > ta THEN sqrt(pow((xb - xa) / (tb - ta), 2) + pow((yb - ya) / (tb - ta), 2)) END AS speed, CASE WHEN tb > ta THEN atan2((yb - ya) / (tb - ta), (xb - xa) / (tb - ta)) END AS a FROM e),
 hd AS (SELECT *, last_value(CASE WHEN speed >= 2 THEN a END IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM v),
 d AS (SELECT *, heading - lag(heading) OVER w AS turn, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS far FROM hd WINDOW w AS (PARTITION BY series ORDER BY seq)),
 c AS (SELECT *, CASE WHEN far > 0 AND turn IS NOT NULL THEN greatest(-300, least(300, atan2(sin(turn), cos(turn)) / far)) END AS c FROM d)
SELECT series, seq, round(speed, 6) AS speed, round(avg(c) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) + 0.0 AS curvature FROM c""")
def w8_kinematics(spark, sf):
    out = op.kinematics(points(spark, sf), "series", "h", 6.0, 2.0)
    return out.select("series", "seq", F.round("speed", 6).alias("speed"), (F.round("curvature", 4) + 0.0).alias("curvature"))


@query(f"""WITH RECURSIVE {_POINTS}, g AS (SELECT series, seq, x AS v, coalesce(round((h - lag(h) OVER (PARTITION BY series ORDER BY seq)) * 3600, 0), 0) AS dt FROM pts),
 w(series, seq, d) AS (SELECT series, seq, CASE WHEN v < 40 THEN 0.0::DOUBLE + dt ELSE 0.0::DOUBLE END FROM g WHERE seq = 1 UNION ALL
  SELECT g.series, g.seq, CASE WHEN v < 40 THEN d + dt ELSE d * 0.85::DOUBLE END FROM w JOIN g ON g.series = w.series AND g.seq = w.seq + 1)
SELECT series, seq, round(d, 3) AS dwell FROM w""")
def w9_dwell(spark, sf):
    w = Window.partitionBy("series").orderBy("seq")
    rows = points(spark, sf).select("series", "seq", F.col("x").alias("v"), F.coalesce(F.round((F.col("h") - F.lag("h").over(w)) * 3600, 0), F.lit(0.0)).alias("dt"))
    return rounded(op.dwell(rows, "series", 40), 3)


@query(f"""WITH {_BUSY}, n AS (SELECT *, max(seq) OVER (PARTITION BY series) + 1 AS n FROM busy), s AS (SELECT *, pow(2, greatest(0, ceil(log2(n / 20))))::BIGINT AS stride FROM n)
SELECT series, seq, b, stride FROM s WHERE (seq // 3) % stride = 0""")
def w12_thin_series(spark, sf):
    return op.thin_series(busy(spark, sf), "series", "seq", 20, 3).select("series", "seq", "b", "stride")


@query("""WITH r AS (SELECT l_partkey, l_linenumber, l_quantity AS size, l_orderkey AS name, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_returnflag DESC, l_quantity DESC, l_orderkey) AS r FROM lineitem)
SELECT l_partkey, l_linenumber, count(*) AS copies, max(name) FILTER (r = 1) AS kept, coalesce(sum(size) FILTER (r > 1), 0) AS reclaimable, min(size) <> max(size) AS sizes_differ FROM r GROUP BY 1, 2""")
def w13_keep_best_copy(spark, sf):
    return op.keep_best_copy(t.table(spark, sf, "lineitem"), ["l_partkey", "l_linenumber"], "l_returnflag", "l_quantity", "l_orderkey")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def w14_session_position(spark, sf):
    return op.session_position(t.table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query(f"""WITH {t.RENDERS} SELECT inputs, file, at_s, row_number() OVER (PARTITION BY inputs ORDER BY at_s, file) AS place, count(*) OVER (PARTITION BY inputs) AS group_size FROM renders""")
def w15_chronology(spark, sf):
    return op.chronology(t.renders(spark, sf).select("inputs", "file", "at_s"), "inputs", ["at_s", "file"])


@query(f"""WITH {t.SERIES}, m AS (SELECT render, median(ms) AS m FROM series GROUP BY render), g AS (SELECT render, pass - lag(pass) OVER (PARTITION BY render ORDER BY pass) AS gap FROM series JOIN m USING (render) WHERE ms > 1.8 * m),
 c AS (SELECT render, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY render ORDER BY n DESC, gap) AS r, sum(n) OVER (PARTITION BY render) AS s FROM c)
SELECT render, s::BIGINT AS gaps, gap AS period, round(n / s, 6) AS share FROM k WHERE r = 1""")
def w16_slow_gaps(spark, sf):
    return rounded(op.slow_gaps(t.series(spark, sf), "render", "pass", "ms", 1.8), 6)
