"""Queries over policies, set operations and batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import policy as op
from ..sources.shared import scratch
from ..sources.snapshots import SnapshotTable
from ..streaming import streams as st
from . import tables as t
from .fleet import rounded
from .registry import query
from .timing import MIN


@query("""WITH b AS (SELECT o_orderkey AS file, o_custkey + 1 AS v, o_totalprice AS ord, 1 AS b FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 200000.0, 0 FROM orders WHERE o_orderkey % 2 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord DESC, b DESC) AS r FROM b) SELECT file, v, ord FROM r WHERE r = 1""")
def a11_upsert_index(spark, sf):
    """Two stand-ins for two days' records, made from one table as it holds no second state: their keys overlap in part."""
    o = t.table(spark, sf, "orders")
    batch = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") + 1).alias("v"), F.col("o_totalprice").alias("ord"))
    index = SnapshotTable(spark, scratch(spark, "index"), "file", "ord")
    index.upsert(o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("v"), F.lit(200000.0).alias("ord")))
    index.upsert(batch)
    return index.read()


@query("""SELECT l_orderkey AS name, count(DISTINCT l_partkey) AS bodies, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1""")
def a12_name_collisions(spark, sf):
    return op.name_collisions(t.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "name"), "name", "l_partkey")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 0""")
def g1_union_sources(spark, sf):
    """Finished orders and those of even keys stand in for two sources that overlap."""
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return op.union_sources(o.filter("o_orderstatus = 'F'"), o.filter("o_orderkey % 2 = 0"), key="o_orderkey")


@query("""SELECT l_quantity, l_partkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def g3_size_twins(spark, sf):
    return op.size_twins(t.table(spark, sf, "lineitem"), ["l_quantity", "l_partkey"], "l_orderkey")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, 4 AS n FROM orders)
SELECT k, n, 'a' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT k, n, 'b' FROM (FROM b EXCEPT ALL FROM a)""")
def g5_tables_equal(spark, sf):
    """Passes that every order has against four that it should have."""
    have = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return op.tables_differ(have, t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("n")))


@query(r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '([A-Z]\w+)\. The', 1) AS m FROM documents), f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(m) = 1 THEN m[1] ELSE 'x' END AS fact FROM e)
SELECT doc_id, CASE WHEN len(m) = 1 THEN m[1] END AS figure, fact, CASE WHEN len(m) = 0 THEN 'not found' WHEN len(m) > 1 THEN 'found twice' WHEN m[1] = fact THEN 'ok' ELSE 'differs' END AS status FROM e JOIN f USING (doc_id)""")
def q1_reconcile_published(spark, sf):
    d = t.table(spark, sf, "documents")
    figures = op.extract_figures(d, "doc_id", "text", r"([A-Z]\w+)\. The")
    facts = figures.select("doc_id", F.when((F.col("doc_id") % 2 == 0) & F.col("figure").isNotNull(), F.col("figure")).otherwise("x").alias("fact"))
    return op.reconcile_published(figures, facts, "doc_id")


@query(f"""WITH {t.RENDERS}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT file, CASE WHEN file % 50 = 0 THEN 'no width' WHEN file % 51 = 0 THEN 'no time' WHEN n IS NULL THEN 'no passes' WHEN n <> 4 THEN 'passes' END AS reason FROM renders LEFT JOIN n ON l_orderkey = file""")
def q2_verify_sidecars(spark, sf):
    rows = t.renders(spark, sf).select("file", F.when(F.col("file") % 50 != 0, F.col("w")).alias("w"), F.when(F.col("file") % 51 != 0, F.col("at_s")).alias("at_s"), F.lit(4).alias("recorded"))
    return op.verify_sidecars(rows, t.passes(spark, sf), "file")


@query("""SELECT count(*) AS n, sum(o_custkey)::BIGINT AS pixels, count(*) = 7000 AND sum(o_custkey) = 5 AS trusted FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'""")
def q3_census_self_check(spark, sf):
    return op.census_self_check(t.table(spark, sf, "orders"), F.col("o_orderdate") < F.expr("timestamp_ntz'1998-01-01 00:00:00'"), 7000, 5, "o_custkey")


@query(f"""WITH {t.RENDERS}, b AS (SELECT file FROM renders ORDER BY ms DESC, file LIMIT 3), k AS (SELECT r.*, count(*) OVER (PARTITION BY inputs) = 1 AS single, b.file IS NOT NULL AS big FROM renders r LEFT JOIN b USING (file))
SELECT file, CASE WHEN state = 'P' THEN 'refused' WHEN engine = '1-URGENT' THEN 'kept' WHEN (ms / 100000 >= 2 OR big) AND file % 17 <> 0 THEN 'hold' ELSE 'sweep' END AS action,
 concat_ws(',', CASE WHEN ms / 100000 >= 2 THEN 'dear' END, CASE WHEN big THEN 'largest' END) AS reasons, CASE WHEN single THEN 'only one of its group' END AS note FROM k""")
def q4_retention_plan(spark, sf):
    r = t.renders(spark, sf).withColumn("hours", F.col("ms") / 100000)
    return op.retention_plan(r, "ms", "hours", F.col("engine") == "1-URGENT", F.col("state") == "P", "inputs", 3, r.filter("file % 17 = 0").select("file"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def q10_inventory_report(spark, sf):
    return op.inventory_report(t.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_orderkey")


_POLLS = t.SAMPLES + ", polls AS (SELECT series AS path, t, (floor(value) % 6)::BIGINT AS size FROM samples), s AS (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY t) AS p FROM polls)"


@query(f"WITH {_POLLS} SELECT path, min(t) AS t, arg_min(size, t) AS size FROM s WHERE p = size GROUP BY path")
def s1_settled_arrivals(spark, sf):
    return st.settled_arrivals(t.samples(spark, sf).select(F.col("series").alias("path"), "t", (F.floor("value") % 6).alias("size")))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey AS x FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS y FROM orders WHERE o_orderkey % 7 > 0)
SELECT k, CASE WHEN x IS NULL THEN 'new' WHEN y IS NULL THEN 'gone' WHEN x <> y THEN 'growing' ELSE 'settled' END AS status FROM a FULL JOIN b USING (k)""")
def s2_growing_files(spark, sf):
    """Two snapshots of one table, made by leaving out every fifth and seventh key and by raising some sizes."""
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"))
    return st.growing_files(o.filter("k % 5 > 0"), o.filter("k % 7 > 0").withColumn("s", F.when(F.col("k") % 3 == 0, F.col("s") + 1).otherwise(F.col("s"))), "k", "s")


@query("""WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events), v AS (SELECT *, CASE WHEN floor(value) % 11 = 0 THEN 'BLACK FRAME' WHEN floor(value) % 7 = 0 THEN 'NOTHING LIT' END AS verdict FROM r WHERE r = 1)
SELECT event_id, verdict, CASE WHEN verdict IS NULL THEN 'index' ELSE 'aside' END AS goes_to FROM v""")
def s3_harvest(spark, sf):
    e = t.table(spark, sf, "events").withColumn("path", F.concat_ws("/", "user_id", "event_type"))
    v = F.floor("value")
    verdict = sc.render_verdict(v % 11, v % 7, F.lit(None).cast("string"), F.lit(0), F.lit(0))
    return st.judged(e, "path", "event_id", verdict).select("event_id", "verdict", "goes_to")


@query(r"""WITH n AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages), o AS (SELECT page_id, host, regexp_extract(host, '^([^-/_.]+)', 1) AS prefix FROM n WHERE regexp_matches(host, '^[a-z]+\.[a-z]+\.'))
SELECT page_id, host, prefix FROM o WHERE prefix NOT IN (SELECT prefix FROM o WHERE page_id % 7 = 0)""")
def s4_unknown_shape_alerts(spark, sf):
    """All pages; the prefixes of every seventh page stand in for the known ones."""
    p = t.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))
    shape = r"^[a-z]+\.[a-z]+\."
    known = p.filter(F.col("host").rlike(shape) & (F.col("page_id") % 7 == 0)).select(F.regexp_extract("host", "^([^-/_.]+)", 1).alias("prefix"))
    return st.unknown_shape_alerts(p, known, "page_id", "host", shape)


@query("""WITH w AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 - k * 3600000000 AS start FROM events, range(2) AS r(k)) SELECT start, event_type, count(*) AS n, round(count(*) / 7200.0, 8) AS per_second FROM w GROUP BY 1, 2""")
def s5_event_rates(spark, sf):
    return rounded(st.event_rates(t.table(spark, sf, "events").withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")), "ts", "event_type", "2 hours", "1 hour", 7200.0), 8)


@query("""WITH w AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 - k * 3600000000 AS start, value FROM events, range(2) AS r(k) WHERE event_id % 3 = 0 AND value IS NOT NULL) SELECT start, count(*) AS n, quantile_disc(value, 0.5) AS median FROM w GROUP BY 1""")
def s5_hover_median(spark, sf):
    e = t.table(spark, sf, "events").select(F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))").alias("ts"), (F.col("event_id") % 3 == 0).alias("hover"), "value")
    return st.hover_median(e, "ts", "hover", "value", "2 hours", "1 hour")


@query(f"""WITH {t.SAMPLES}, m AS (SELECT *, max(t) OVER (PARTITION BY series) AS m FROM samples), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS r, count(*) OVER (PARTITION BY series) AS n FROM m WHERE t >= m - {7 * 1440 * MIN})
SELECT id, n > 12 AS full FROM k WHERE r <= 12""")
def s6_bounded_history(spark, sf):
    return st.bounded_history(t.samples(spark, sf), "series", "t", 7 * 1440 * MIN, 12).select("id", "full")


@query(f"""WITH {t.SAMPLES}, g AS (SELECT id, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap, value * {10 * MIN} AS cost FROM samples), f AS (SELECT id, gap, cost > {900 * MIN} AS overran, gap > {1800 * MIN} AS late FROM g) SELECT * FROM f WHERE overran OR late""")
def s7_sampler_overruns(spark, sf):
    s = t.samples(spark, sf).withColumn("cost", F.col("value") * (10 * MIN))
    return st.sampler_overruns(s, "series", "t", "cost", 900 * MIN).select("id", "gap", "overran", "late")


@query("""WITH p AS (SELECT conv_id, length(text) AS mb, turn AS pid FROM conversations WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mb DESC, pid DESC) AS r FROM p)
SELECT conv_id, count(*)::INT AS procs, sum(mb)::BIGINT AS total, max(mb) AS biggest, string_agg(mb || ':' || pid, ',' ORDER BY r) FILTER (r <= 3) AS top FROM r GROUP BY conv_id""")
def s8_top_processes(spark, sf):
    rows = t.table(spark, sf, "conversations").filter("text is not null").groupBy("conv_id").agg(F.collect_list(F.struct(F.char_length("text").cast("long").alias("mb"), F.col("turn").alias("pid"))).alias("p"))
    return st.top_processes(rows, "conv_id", "p", 3)


@query(r"""SELECT doc_id, '{"id":' || doc_id || ',"s":"}{\"","n":{"lang":"' || lang || '"}}' AS meta, length(text) + 6 AS start FROM documents""")
def a2_extract_embedded_json(spark, sf):
    from ..sources.files import extract_embedded_json

    meta = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"s":"}{\\"","n":{"lang":"'), F.col("lang"), F.lit('"}}'))
    rows = t.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n@@J: "), meta, F.lit(" tail { @@J: {")).alias("body"))
    return extract_embedded_json(rows, "doc_id", "body", "@@J:").select("doc_id", "meta", "start")


@query("""SELECT vec_id, 0 AS stroke, (i - 1)::INT AS seq, embedding[3 * i - 2]::DOUBLE AS x, embedding[3 * i - 1]::DOUBLE AS y, embedding[3 * i]::DOUBLE AS t FROM (SELECT *, unnest(range(1, 22)) AS i FROM embeddings)""")
def a10_scan_strokes(spark, sf):
    from ..sources.text import scan_strokes

    body = F.to_json(F.array(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 3 + 1, 3))))
    return scan_strokes(t.table(spark, sf, "embeddings").select("vec_id", body.alias("b")), "vec_id", "b")
