"""Queries over samples, windows and the joins between them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as op
from ..operators import hardware as hw
from . import tables as t
from .fleet import rounded
from .registry import query

MIN = 60_000_000

#: Windows of ``value`` minutes that begin at the purchases of a user.
WINDOWS = t.SAMPLES + f", windows AS (SELECT id AS key, series, t AS t0, t + (value * {MIN})::BIGINT AS t1 FROM samples WHERE kind = 'purchase')"


def windows(spark, sf):
    s = t.samples(spark, sf)
    return s.filter("kind = 'purchase'").select(F.col("id").alias("key"), "series", F.col("t").alias("t0"), (F.col("t") + F.round(F.col("value") * MIN).cast("long")).alias("t1"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def c1_needs_harvest(spark, sf):
    """Every customer against the dear orders, which stand in for the sidecars that exist already."""
    sidecars = t.table(spark, sf, "orders").filter("o_totalprice > 400000")
    return op.needs_harvest(t.table(spark, sf, "customer"), sidecars, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders a WHERE a.o_orderstatus = 'F' AND a.o_custkey IS NOT DISTINCT FROM o.o_custkey
 AND a.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority) AND o.o_orderstatus = 'O'""")
def c2_already_archived(spark, sf):
    """Open orders against finished ones: the table's states stand in for incoming and archived files."""
    o = t.table(spark, sf, "orders")
    return op.already_archived(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_orderstatus = 'F' AND a.o_custkey IS NOT DISTINCT FROM o.o_custkey
 AND a.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority) AND o.o_orderstatus = 'O'""")
def c2_not_archived(spark, sf):
    """The other side of c2_already_archived, with the same stand-ins."""
    o = t.table(spark, sf, "orders")
    return op.already_archived(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], False).select("o_orderkey")


@query(f"""WITH {WINDOWS} SELECT s.id, w.key FROM samples s JOIN windows w ON s.series = w.series AND s.t BETWEEN w.t0 AND w.t1""")
def c3_samples_in_windows(spark, sf):
    return op.samples_in_windows(t.samples(spark, sf), windows(spark, sf), by=("series",)).select("id", "key")


@query(f"""WITH {WINDOWS} SELECT a.key AS a, b.key AS b FROM windows a JOIN windows b ON a.series = b.series AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE a.key < b.key""")
def c4_overlapping(spark, sf):
    w = windows(spark, sf)
    a, b = w.select(F.col("key").alias("a"), "series", F.col("t0").alias("a0"), F.col("t1").alias("a1")), w.select(F.col("key").alias("b"), "series", F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return op.overlapping(a, b, ("a0", "a1"), ("b0", "b1"), ("series",)).filter("a < b").select("a", "b")


@query(f"""WITH {WINDOWS} SELECT id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.series = s.series AND s.t BETWEEN w.t0 - {60 * MIN} AND w.t1 + {300 * MIN})""")
def c5_outside_all_windows(spark, sf):
    return op.outside_all_windows(t.samples(spark, sf), windows(spark, sf), 60 * MIN, 300 * MIN, by=("series",)).select("id")


@query(f"""WITH {t.SAMPLES}, r AS (SELECT series, t AS rt, value AS rv FROM samples WHERE kind = 'view'),
 j AS (SELECT s.id, rt, rv, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.t - rt), rt) AS k FROM samples s JOIN r ON s.series = r.series AND abs(s.t - rt) <= {240 * MIN} WHERE s.kind = 'click')
SELECT s.id, j.rt AS near_t, j.rv AS near_value FROM samples s LEFT JOIN j ON s.id = j.id AND k = 1 WHERE s.kind = 'click'""")
def c6_nearest_in_time(spark, sf):
    s = t.samples(spark, sf)
    right = s.filter("kind = 'view'").select("series", F.col("t").alias("rt"), F.col("value").alias("rv"))
    return op.nearest_in_time(s.filter("kind = 'click'"), right, 240 * MIN, "rv", by=("series",)).select("id", "near_t", "near_value")


@query("""WITH tp AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS nat, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS seg, n_name AS name FROM nation),
 r AS (SELECT s_suppkey AS k, s_nationkey AS nat, (s_suppkey % 5)::INT AS seg FROM supplier),
 h AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY ord) AS i FROM r JOIN tp ON (tp.nat IS NULL OR tp.nat = r.nat) AND (tp.seg IS NULL OR tp.seg = r.seg))
SELECT r.k, h.name FROM r LEFT JOIN h ON h.k = r.k AND i = 1""")
def c7_match_templates(spark, sf):
    n = t.table(spark, sf, "nation")
    templates = n.select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("nat"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("seg"), F.col("n_name").alias("name"))
    rows = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nat"), (F.col("s_suppkey") % 5).cast("int").alias("seg"))
    return op.match_templates(rows, templates, "k", ["nat", "seg"], "ord", "name").select("k", "name")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'missing' ELSE 'stale' END AS status FROM a FULL JOIN b USING (k)""")
def c8_reconcile_keys(spark, sf):
    """Customers but for every fourth against all orders, so that either side lacks keys of the other."""
    a = t.table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return op.reconcile_keys(a, t.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"""WITH {t.PASSES}, w AS (SELECT *, first_value(ms) OVER p AS reference, row_number() OVER p AS r FROM passes WINDOW p AS (PARTITION BY part ORDER BY render, pass))
SELECT part, render, pass, reference, round(ms - reference, 2) AS delta FROM w WHERE r > 1""")
def c10_compare_to_reference(spark, sf):
    out = op.compare_to_reference(t.passes(spark, sf), "part", ["render", "pass"], "ms")
    return out.select("part", "render", "pass", "reference", F.round("delta", 2).alias("delta"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS name, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'A'), d AS (SELECT DISTINCT l_partkey AS name, l_linenumber AS at_line FROM lineitem WHERE l_returnflag = 'R'),
 m AS (SELECT p.name, p.line, at_line, abs(line - at_line) AS gap, row_number() OVER (PARTITION BY p.name, p.line ORDER BY abs(line - at_line), at_line) AS r FROM p LEFT JOIN d USING (name))
SELECT name, line, at_line AS nearest, CASE WHEN at_line IS NULL THEN 'undeclared' WHEN gap = 0 THEN 'exact' ELSE 'moved' END AS status FROM m WHERE r = 1""")
def c12_nearest_declaration(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("line"), "l_returnflag")
    pins, decls = rows.filter("l_returnflag = 'A'").select("name", "line").distinct(), rows.filter("l_returnflag = 'R'").select("name", F.col("line").alias("at_line")).distinct()
    return op.nearest_declaration(pins, decls, "name", "line", "at_line")


@query("""SELECT s_suppkey, c_mktsegment AS claimed, s_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey""")
def c14_misfiled(spark, sf):
    folders = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("claimed"), "c_mktsegment")
    out = op.misfiled(t.table(spark, sf, "supplier"), folders, "s_suppkey", "s_nationkey")
    return out.select("s_suppkey", F.col("c_mktsegment").alias("claimed"), "s_nationkey")


@query(f"""WITH {t.PASSES}, e AS (SELECT render, pass AS i, bytes AS size FROM passes), m AS (SELECT render, pass AS i, CASE WHEN worker % 7 = 0 THEN bytes + 1 ELSE bytes END AS recorded FROM passes WHERE NOT (worker % 11 = 0 AND pass > 2)),
 n AS (SELECT * FROM (SELECT render, count(*) AS stored FROM e GROUP BY 1) JOIN (SELECT render, count(*) AS listed FROM m GROUP BY 1) USING (render)),
 d AS (SELECT render, count(*) FILTER (size <> recorded) AS differ, min(i) FILTER (size <> recorded) AS first FROM e JOIN m USING (render, i) GROUP BY 1)
SELECT render, stored, listed, CASE WHEN stored = listed THEN differ END AS differ, CASE WHEN stored = listed THEN first END AS first FROM n JOIN d USING (render)""")
def c15_directory_agrees(spark, sf):
    p = t.passes(spark, sf)
    e = p.select("render", F.col("pass").alias("i"), F.col("bytes").alias("size"))
    m = p.filter("not (worker % 11 = 0 and pass > 2)").select("render", F.col("pass").alias("i"), F.when(F.col("worker") % 7 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("recorded"))
    return op.directory_agrees(e, m, "render")


@query("""WITH c AS (SELECT l_orderkey AS cell, CASE WHEN l_suppkey % 3 > 0 THEN CASE WHEN l_partkey % 4 > 0 THEN l_orderkey ELSE l_orderkey + 1 END END AS address FROM lineitem),
 v AS (SELECT cell, address, count(*) AS n FROM c WHERE address IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT cell, address AS mark, row_number() OVER (PARTITION BY cell ORDER BY n DESC, address DESC) AS r FROM v)
SELECT c.cell, m.mark, CASE WHEN m.mark IS NULL THEN 'unmarked' WHEN m.mark = c.cell THEN 'in place' ELSE 'moved' END AS status FROM (SELECT DISTINCT cell FROM c) c LEFT JOIN m ON m.cell = c.cell AND r = 1""")
def c16_address_check(spark, sf):
    l = t.table(spark, sf, "lineitem")
    return op.address_check(l.select(F.col("l_orderkey").alias("cell"), F.when(F.col("l_suppkey") % 3 > 0, F.when(F.col("l_partkey") % 4 > 0, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 1)).alias("address")))


_BUSY = t.SAMPLES + ", busy AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS seq, (floor(value) % 9)::BIGINT AS b FROM samples)"


def busy(spark, sf):
    w = Window.partitionBy("series").orderBy("t")
    return t.samples(spark, sf).select("series", (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.floor("value") % 9).alias("b"), "t")


@query(f"""WITH {_BUSY} SELECT series, round(avg(b), 6) AS mean_busy, round(100 * avg(b) / 8, 6) AS percent, sum((8 - b) * 500)::BIGINT AS idle FROM busy GROUP BY series""")
def d18_utilisation(spark, sf):
    return rounded(hw.utilisation(busy(spark, sf), "series", 8, 500), 6)


@query(f"""WITH {_BUSY} SELECT series, least(b, 6) AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series), 6) AS share FROM busy GROUP BY series, least(b, 6)""")
def d19_busy_histogram(spark, sf):
    return rounded(hw.busy_histogram(busy(spark, sf), "series", 6), 6)


@query(f"""WITH {WINDOWS}, s AS (SELECT series, t AS a0, t + (value * {MIN})::BIGINT AS a1 FROM samples WHERE kind = 'error'),
 o AS (SELECT key, sum(least(t1, a1) - greatest(t0, a0)) AS busy FROM windows w JOIN s ON w.series = s.series AND t0 < a1 AND a0 < t1 GROUP BY key)
SELECT key, CASE WHEN t1 > t0 THEN round(coalesce(busy, 0) / (t1 - t0), 6) END AS occupancy FROM windows LEFT JOIN o USING (key)""")
def d21_occupancy(spark, sf):
    spans = t.samples(spark, sf).filter("kind = 'error'").select("series", F.col("t").alias("a0"), (F.col("t") + F.round(F.col("value") * MIN).cast("long")).alias("a1"))
    return rounded(op.occupancy(spans, windows(spark, sf), ("series",)), 6)


@query(f"""WITH {t.SAMPLES}, v AS (SELECT round((t / 1000000 - (t // 3600000000 * 3600 - (series % 3) * 3600)) / 3600)::BIGINT AS hours FROM samples), g AS (SELECT hours, count(*) AS agree FROM v GROUP BY 1)
SELECT hours, agree, (SELECT count(*) FROM v) AS total FROM g ORDER BY agree DESC, hours LIMIT 1""")
def d23_vote_offset(spark, sf):
    s = t.samples(spark, sf)
    return hw.vote_offset(s.select((F.col("t") / 1_000_000).alias("utc"), (F.expr("t div 3600000000") * 3600 - (F.col("series") % 3) * 3600).alias("local")))


@query(f"""WITH {WINDOWS}, q AS (SELECT id, series, value FROM samples s WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.series = s.series AND s.t BETWEEN w.t0 AND w.t1)),
 r AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS i, count(*) OVER (PARTITION BY series) AS n FROM q),
 g AS (SELECT series, count(*) AS n, max(value) FILTER (i = greatest(ceil(n * 0.1), 1)) AS p10, max(value) FILTER (i = greatest(ceil(n * 0.5), 1)) AS p50, avg(value) AS mean FROM r GROUP BY series)
SELECT g.series, g.n, p10, p50, round(mean, 8) AS mean, round(avg((value > p10 + 1)::INT), 8) AS above,
 CASE WHEN g.n <= 20 THEN 'too few' WHEN p10 > 8 THEN 'floor too high' WHEN mean > p10 + 60 THEN 'not idle' END AS refused FROM g JOIN q USING (series) GROUP BY ALL""")
def d24_idle_floor(spark, sf):
    idle = op.outside_all_windows(t.samples(spark, sf), windows(spark, sf), 0, 0, by=("series",))
    return rounded(hw.idle_floor(idle, "series", "value", least=20, most_floor=8, most_over=60), 8)


@query(f"""WITH {WINDOWS} SELECT key, count(*) AS n, round(avg(value) FILTER (kind = 'view'), 6) AS view, round(avg(value) FILTER (kind = 'click'), 6) AS click, round(avg(value) FILTER (kind = 'error'), 6) AS error,
 round((avg(value) FILTER (kind = 'view') - 5) / 8, 6) AS above_floor FROM samples s JOIN windows w ON s.series = w.series AND s.t BETWEEN w.t0 AND w.t1 GROUP BY key""")
def d25_render_hardware(spark, sf):
    hit = op.samples_in_windows(t.samples(spark, sf), windows(spark, sf), by=("series",))
    return rounded(hw.render_hardware(hit, "key", "kind", "value", ["view", "click", "error"], "view", 5, 8), 6)


@query(f"""WITH {WINDOWS}, h AS (SELECT key, t, value, (t - lag(t) OVER (PARTITION BY key ORDER BY t)) / 1e6 AS dt, t1 - t0 AS size FROM samples s JOIN windows w ON s.series = w.series AND s.t BETWEEN w.t0 AND w.t1),
 g AS (SELECT key, any_value(size) / 1e6 AS size, sum(value * dt) AS written, count(*) FILTER (value > 100) AS over_n, min(t) FILTER (value > 100) AS over_first, max(t) FILTER (value > 100) AS over_last FROM h GROUP BY key)
SELECT key, round(written, 3) AS written, written > size * 1.15 AS is_foreign, over_n, over_first, over_last FROM g""")
def d26_foreign_io(spark, sf):
    hit = op.samples_in_windows(t.samples(spark, sf), windows(spark, sf).withColumn("size", (F.col("t1") - F.col("t0")) / 1e6), by=("series",))
    return rounded(hw.foreign_io(hit, "key", "t", "value", "size", 100), 3)


_PHASED = t.SAMPLES + """, hot AS (SELECT series, id, t, value, row_number() OVER (PARTITION BY series ORDER BY t) AS seq FROM samples),
 h AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY series ORDER BY seq) > 4 THEN 1 ELSE 0 END AS cut FROM hot WHERE value > 60),
 r AS (SELECT *, sum(cut) OVER (PARTITION BY series ORDER BY seq) AS run FROM h),
 runs AS (SELECT series, run, min(seq) AS a, max(seq) AS b, count(*) AS n FROM r GROUP BY series, run HAVING max(seq) > min(seq)),
 best AS (SELECT series, a, b FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b - a DESC, a) AS k FROM runs) WHERE k = 1),
 phased AS (SELECT hot.series, id, t, seq, value, CASE WHEN a IS NULL THEN NULL WHEN seq < a THEN 'pre' WHEN seq <= b THEN 'loaded' ELSE 'post' END AS phase FROM hot LEFT JOIN best USING (series))"""


def phased(spark, sf):
    from ..operators.sequence import longest_run

    w = Window.partitionBy("series").orderBy("t")
    return longest_run(t.samples(spark, sf).withColumn("seq", F.row_number().over(w)), "series", "seq", F.col("value") > 60, 3)


@query(f"""WITH {_PHASED} SELECT id, phase FROM phased""")
def w3_longest_run(spark, sf):
    return phased(spark, sf).select("id", "phase")


@query(f"""WITH {_PHASED} SELECT series, round(avg(value) FILTER (phase = 'pre'), 6) AS pre_mean, max(value) FILTER (phase = 'pre') AS pre_peak, round(avg(value) FILTER (phase = 'loaded'), 6) AS loaded_mean,
 max(value) FILTER (phase = 'loaded') AS loaded_peak, round(avg(value) FILTER (phase = 'post'), 6) AS post_mean, max(value) FILTER (phase = 'post') AS post_peak FROM phased GROUP BY series""")
def d27_phase_means(spark, sf):
    return rounded(hw.phase_means(phased(spark, sf), "series", "phase", "value"), 6)


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS yes, round(avg((l_quantity >= 0.95 * 50)::INT), 6) AS at_limit FROM lineitem GROUP BY 1""")
def d28_throttle_flags(spark, sf):
    return rounded(hw.throttle_flags(t.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", 50), 6)


@query(f"""WITH {t.SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS i, count(*) OVER (PARTITION BY series) AS n FROM samples),
 g AS (SELECT series, count(*) AS n, avg(value) FILTER (i <= n // 3) AS a, avg(value) FILTER (i > n - n // 3) AS b FROM n GROUP BY series), c AS (SELECT *, CASE WHEN n >= 9 THEN b / a - 1 END AS c FROM g)
SELECT series, n, round(a, 6) AS first_third, round(b, 6) AS last_third, round(c, 6) AS change, CASE WHEN c > 0.03 THEN 'rising' WHEN c < -0.1 THEN 'falling' WHEN c IS NOT NULL THEN 'steady' END AS drift FROM c""")
def d29_drift_thirds(spark, sf):
    return rounded(hw.drift_thirds(t.samples(spark, sf), "series", "t", "value"), 6)


@query("""SELECT l_suppkey AS core, round(avg(l_extendedprice) FILTER (l_linenumber % 2 = 0), 6) AS t0, round(avg(l_extendedprice) FILTER (l_linenumber % 2 = 1), 6) AS t1,
 round(avg(l_extendedprice) FILTER (l_linenumber % 2 = 1) / avg(l_extendedprice) FILTER (l_linenumber % 2 = 0), 6) AS sibling FROM lineitem GROUP BY 1""")
def d30_sibling_ratio(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("core"), (F.col("l_linenumber") % 2).alias("thread"), F.col("l_extendedprice").alias("v"))
    return rounded(hw.sibling_ratio(rows, "core", "thread", "v"), 6)


@query(f"""WITH {t.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM samples),
 g AS (SELECT series, avg(value) AS mean, max(value) AS peak, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY series)
SELECT series, round(mean, 8) AS mean, peak, p50, p95, CASE WHEN p50 >= 0.95 * peak THEN 'saturated' WHEN p95 >= 3 * p50 THEN 'bursty' ELSE 'headroom' END AS verdict FROM g""")
def d31_burst_profile(spark, sf):
    return rounded(hw.burst_profile(t.samples(spark, sf), "series", "value"), 8)


@query(f"""WITH {t.SAMPLES}, d AS (SELECT *, (t - lag(t) OVER (PARTITION BY series ORDER BY t)) / 1e6 AS dt FROM samples),
 g AS (SELECT series, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, max(value) AS peak, sum(value * dt) AS total FROM d GROUP BY series)
SELECT series, round(mean, 6) AS mean, round(p95, 6) AS p95, peak, round(total, 2) AS total, peak > 5 * mean AS peaky FROM g""")
def d32_drive_profile(spark, sf):
    out = hw.drive_profile(t.samples(spark, sf), "series", "t", "value")
    return out.select("series", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), "peak", F.round("total", 2).alias("total"), "peaky")


@query(f"""WITH {t.SAMPLES}, r AS (SELECT series, t AS rt, value AS rv FROM samples WHERE kind = 'view'),
 j AS (SELECT s.id, rv, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.t - rt), rt) AS k FROM samples s JOIN r ON s.series = r.series AND abs(s.t - rt) <= {600 * MIN} WHERE s.kind <> 'view'),
 a AS (SELECT s.series, s.id, j.rv, row_number() OVER (PARTITION BY s.series ORDER BY s.value DESC, s.id) AS q FROM samples s LEFT JOIN j ON s.id = j.id AND k = 1 WHERE s.kind <> 'view'),
 g AS (SELECT series, avg(rv) FILTER (q <= 10) AS x, avg(rv) FILTER (q > 10) AS y FROM a GROUP BY series)
SELECT series, round(x, 6) AS slow_mean, round(y, 6) AS rest_mean, abs(x / y - 1) > 0.25 AS differs FROM g""")
def d33_slow_vs_rest(spark, sf):
    """Views are the log's readings and all other events the tiles that are timed against them."""
    s = t.samples(spark, sf)
    tiles = s.filter("kind <> 'view'").withColumn("q", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("value"), "id")))
    right = s.filter("kind = 'view'").select("series", F.col("t").alias("rt"), F.col("value").alias("rv"))
    near = op.nearest_in_time(tiles, right, 600 * MIN, "rv", by=("series",))
    return rounded(hw.slow_vs_rest(near, "series", "q", 10, "near_value"), 6)


_SESSION = t.SAMPLES + ", runs AS (SELECT series * 1000 + t // 86400000000 % 30 AS session, kind, t, value + 1 AS ms FROM samples)"


def runs(spark, sf):
    return t.samples(spark, sf).select((F.col("series") * 1000 + F.expr("t div 86400000000") % 30).alias("session"), "kind", "t", (F.col("value") + 1).alias("ms"))


_DRIFT = """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) AS i FROM runs),
 g AS (SELECT session, count(*) AS runs, arg_min(ms, t) AS f, max(ms) FILTER (i = 2) AS s, arg_max(ms, t) AS l, min(ms) AS b FROM n GROUP BY session)"""


@query(f"""WITH {_SESSION}{_DRIFT} SELECT session, runs, round(s / f, 6) AS second_first, round(l / b, 6) AS last_best, abs(l / f - 1) > 0.05 AS untrusted FROM g""")
def d34_session_drift(spark, sf):
    return rounded(hw.session_drift(runs(spark, sf), "session", "t", "ms"), 6)


@query(f"""WITH {_SESSION}{_DRIFT}, m AS (SELECT session, kind, ms, row_number() OVER (PARTITION BY session, kind ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY session, kind) AS c FROM runs)
SELECT session, kind, ms AS median, abs(l / f - 1) > 0.05 AS untrusted FROM m JOIN g USING (session) WHERE m.i = c // 2""")
def d35_interleaved_medians(spark, sf):
    return hw.interleaved_medians(runs(spark, sf), "session", "kind", "t", "ms")


@query(f"""WITH {WINDOWS}, h AS (SELECT key, any_value(t1 - t0) / 1e6 AS wall, avg(value) AS busy FROM samples s JOIN windows w ON s.series = w.series AND s.t BETWEEN w.t0 AND w.t1 GROUP BY key)
SELECT key, round(wall * busy, 3) AS core_s, CASE WHEN wall <= 1.1 * 3000 THEN 'as fast' WHEN wall * busy > 1.1 * 3000 * 40 THEN 'work' WHEN busy < 0.9 * 40 THEN 'schedule' ELSE 'machine' END AS verdict FROM h""")
def d36_core_seconds(spark, sf):
    w = windows(spark, sf).withColumn("wall", (F.col("t1") - F.col("t0")) / 1e6)
    h = op.samples_in_windows(t.samples(spark, sf), w, by=("series",)).groupBy("key").agg(F.first("wall").alias("wall"), F.avg("value").alias("busy"))
    return rounded(hw.core_seconds(h, "wall", "busy", 3000, 40).select("key", "core_s", "verdict"), 3)
