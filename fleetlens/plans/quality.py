"""Queries over scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import tables as t
from .fleet import rounded
from .registry import query


@query("""SELECT o_orderkey AS file, o_custkey AS inputs, o_orderpriority AS engine, o_totalprice AS ms, (o_custkey % 2)::BOOLEAN AS glow_auto, NULL::VARCHAR AS build FROM orders""")
def b1_to_index_row(spark, sf):
    nested = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("inputs"), F.struct(F.col("o_orderpriority").alias("engine"), F.col("o_totalprice").alias("ms"), (F.col("o_custkey") % 2).alias("glow")).alias("m"))
    return sc.to_index_row(nested, {"file": "file", "inputs": "inputs", "engine": "m.engine", "ms": "m.ms", "glow_auto": "m.glow", "build": "build"}, ["glow_auto"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * h)::BIGINT AS pixels, l_partkey * h / 1e9 AS gigapixels, CASE WHEN l_partkey * h = 0 THEN 0 ELSE l_extendedprice / (l_partkey * h) END AS bytes_per_pixel
FROM (SELECT *, coalesce(CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END, round(l_partkey * 0.625)::BIGINT) AS h FROM lineitem)""")
def b2_pixel_metrics(spark, sf):
    l = t.table(spark, sf, "lineitem")
    px, gp, bpp = sc.pixel_metrics(F.col("l_partkey"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")), F.col("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px, gp, bpp)


@query("""SELECT o_orderkey, (CASE WHEN s < 310 THEN 'uv' WHEN s >= 390 THEN 'day' ELSE 'sp' || s END) || CASE WHEN o_orderkey % 3 = 0 THEN 'x' || replace(printf('%.1f', (o_orderkey % 10) / 10), '.', '_') ELSE '' END AS light
FROM (SELECT *, 280 + o_custkey % 130 AS s FROM orders)""")
def b3_light_label(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", sc.light_label(280 + F.col("o_custkey") % 130, F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 10) / 10)).alias("light"))


@query(r"""SELECT page_id, coalesce(rec, ag, fi) AS name, CASE WHEN rec IS NOT NULL THEN 'recorded' WHEN ag IS NOT NULL THEN 'agent' WHEN fi IS NOT NULL THEN 'name' ELSE 'nothing' END AS basis FROM
 (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'blink' END AS rec, CASE WHEN regexp_matches(url, 'blog') THEN 'webkit' WHEN regexp_matches(url, '^https') THEN 'blink' END AS ag, CASE WHEN regexp_matches(url, '\.html') THEN 'gecko' END AS fi FROM pages)""")
def b4_engine_of(spark, sf):
    e = sc.engine_of(F.when(F.col("page_id") % 7 == 0, F.lit("blink")), F.col("url"), F.col("url"), [("blog", "webkit"), ("^https", "blink")], [(r"\.html", "gecko")])
    return t.table(spark, sf, "pages").select("page_id", e.alias("e")).select("page_id", "e.name", "e.basis")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 5000 THEN 'desktop' WHEN c_nationkey < 8 THEN 'phone' WHEN c_mktsegment = 'MACHINERY' THEN 'tablet' END AS device FROM customer""")
def b5_classify_device(spark, sf):
    rules = [((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000), "desktop"), (F.col("c_nationkey") < 8, "phone"), (F.col("c_mktsegment") == "MACHINERY", "tablet")]
    return t.table(spark, sf, "customer").select("c_custkey", sc.classify(rules).alias("device"))


@query("""SELECT doc_id, doc_id % 12 > 4 OR (doc_id % 12 = 4 AND n_chars % 9 >= 3) AS gte FROM documents""")
def b6_build_gte(spark, sf):
    b = F.concat_ws(".", (F.col("doc_id") % 12).cast("string"), (F.col("n_chars") % 9).cast("string"))
    return t.table(spark, sf, "documents").select("doc_id", sc.build_gte(b, F.lit("4.3")).alias("gte"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'recorded' WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 12 >= 6 THEN 'missing' ELSE 'predates' END AS state FROM documents""")
def b7_recorded_state(spark, sf):
    build = F.when(F.col("doc_id") % 5 != 0, F.concat_ws(".", (F.col("doc_id") % 12).cast("string"), F.lit("1")))
    return t.table(spark, sf, "documents").select("doc_id", sc.recorded_state(F.when(F.col("lang") == "en", F.lit("x")), build, "6.0").alias("state"))


@query(r"""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#(\d{5})(\d{4})$', 1) AS slab, regexp_extract(c_name, '^([A-Za-z]+)#(\d{5})(\d{4})$', 2) AS batch, regexp_extract(c_name, '^([A-Za-z]+)#(\d{5})(\d{4})$', 3) AS number FROM customer""")
def b8_parse_export_name(spark, sf):
    return t.table(spark, sf, "customer").select("c_custkey", *sc.parse_name(F.col("c_name"), r"^([A-Za-z]+)#(\d{5})(\d{4})$", ["slab", "batch", "number"]))


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '-' || o_custkey || '-' || strftime(o_orderdate, '%m%d') AS name FROM orders""")
def b9_canonical_name(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", sc.canonical_name(F.col("o_orderpriority"), F.col("o_custkey"), F.date_format("o_orderdate", "MMdd")).alias("name"))


@query("""SELECT event_id, CASE WHEN floor(value) % 11 = 0 THEN 'BLACK FRAME' WHEN floor(value) % 7 = 0 THEN 'NOTHING LIT' WHEN event_type = 'view' AND user_id > 0 AND user_id % 2 = 0 AND event_id % 3 = 0 THEN 'EMPTY STONE' END AS verdict FROM events""")
def b10_render_verdict(spark, sf):
    v = F.floor("value")
    return t.table(spark, sf, "events").select("event_id", sc.render_verdict(v % 11, v % 7, F.when(F.col("event_type") == "view", "stone"), F.col("user_id"), F.col("user_id") % 2, F.col("event_id") % 3).alias("verdict"))


@query(r"""SELECT page_id, regexp_replace(url, '[/\\]?[^/\\]*$', '') AS folder, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages""")
def b11_split_path(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", *sc.split_path(F.col("url")))


_STATE = """'{"o_custkey":' || o_custkey || ',"o_totalprice":' || o_totalprice || ',"col3":' || CASE WHEN o_orderstatus = 'F' THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}'"""


@query(f"WITH {t.CRC_TABLE}, s AS (SELECT o_orderkey, list_transform(string_split({_STATE}, ''), lambda x: ord(x)) AS b FROM orders) SELECT o_orderkey, printf('%x', {t.crc_sql('b')}) AS signature FROM s, crc_table")
def b12_state_signature(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", sc.state_signature(F.col("o_custkey"), F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("signature"))


_HOLES = "regexp_replace(regexp_replace(text, ' ([a-z]{2}) ', ' {\\1} ', 'g'), 'th', '{th}', 'g')"


def holes():
    return F.regexp_replace(F.regexp_replace("text", " ([a-z]{2}) ", " {$1} "), "th", "{th}")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(" + _HOLES + r", '\{(\w+)\}', 1))), ',') AS holes FROM documents")
def b13_placeholders(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.array_join(sc.placeholders(holes()), ",").alias("holes"))


@query(r"""SELECT page_id, regexp_matches(html, '&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);') AS entity FROM pages""")
def b14_html_entities(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", sc.has_entity(F.col("html")).alias("entity"))


@query(r"""SELECT doc_id, length(text) >= 34 AND length(text) - length(replace(text, ' ', '')) >= 5 AND regexp_matches(split_part(text, chr(10), 1), '[a-z]{3}') AND NOT regexp_matches(text, '[<>{}]')
 AND NOT regexp_matches(text, '^[0-9]') AND NOT regexp_matches(text, '\b(sans-serif|ui-monospace|monospace|system-ui)\b') AS prose FROM documents""")
def b14_has_prose(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", sc.has_prose(F.col("text")).alias("prose"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents), d AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS term FROM part UNION SELECT unnest(['und', 'the', 'des', 'los']))
SELECT doc_id, term, upper(term) AS better FROM w JOIN d USING (term)""")
def b15_lint_terms(spark, sf):
    d = t.table(spark, sf, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("term"))
    fixed = t.table(spark, sf, "region").select(F.explode(F.array(*[F.lit(x) for x in ("und", "the", "des", "los")])).alias("term"))
    return sc.lint_terms(t.table(spark, sf, "documents"), "doc_id", "text", d.unionByName(fixed).distinct().withColumn("better", F.upper("term")))


_FOLDED = r"trim(regexp_replace(translate(strip_accents(lower(text)), 'łđøħŧı', 'ldohti'), '[-‐-― \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"SELECT doc_id, md5({_FOLDED}) AS folded, regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])et') AS starts_et FROM documents")
def b16_fold_text(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.md5(sc.fold_text(F.col("text")).cast("binary")).alias("folded"), sc.starts_word(F.col("text"), "et").alias("starts_et"))


@query("""SELECT event_id, round(CASE WHEN event_id % 4 > 0 THEN 90 - degrees(atan2(1, sqrt(pow(tan(radians(user_id % 60)), 2) + pow(tan(radians(event_id % 50)), 2)))) ELSE 90 - degrees((user_id % 15) / 10) END, 6) AS lean FROM events""")
def b17_lean_deg(spark, sf):
    return rounded(t.table(spark, sf, "events").select("event_id", sc.lean_deg(F.when(F.col("event_id") % 4 > 0, F.col("user_id") % 60), F.col("event_id") % 50, (F.col("user_id") % 15) / 10).alias("lean")), 6)


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(-p-\d+)?(\.[A-Za-z]{2,5})?$', '') AS stem, TRY_CAST(nullif(regexp_extract(url, '(\d{2,3})\s*[xX]\s*(\d{2,3})', 1), '') AS INT) AS inches_w,
 TRY_CAST(nullif(regexp_extract(url, '(\d{2,3})\s*[xX]\s*(\d{2,3})', 2), '') AS INT) AS inches_h FROM pages""")
def b18_strip_derivative(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", sc.strip_derivative(F.col("url")).alias("stem"), *sc.slab_inches(F.col("url")))


@query("""SELECT p_partkey, nullif(regexp_extract(lower(p_type), '(honed|polished|leathered|brushed)', 1), '') AS finish FROM part""")
def b18_finish(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", sc.finish(F.col("p_type")).alias("finish"))


@query("""WITH a AS (SELECT p_partkey, p_type, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 4) AS w FROM part), k AS (SELECT *, list_filter(w, lambda x: x NOT IN ('small', 'large')) AS k FROM a),
 n AS (SELECT *, CASE WHEN len(k) > 0 THEN k ELSE w END AS tk FROM k) SELECT p_partkey, array_to_string(tk, ' ') AS tokens, len(list_filter(tk, lambda x: contains(regexp_replace(lower(p_type || ' ring-bolt widget'), '[^a-z0-9]+', '', 'g'), x)))::INT AS score FROM n""")
def b19_token_score(spark, sf):
    tokens = sc.name_tokens(F.col("p_name"), ["small", "large"])
    return t.table(spark, sf, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"), sc.token_score(tokens, F.concat("p_type", F.lit(" ring-bolt widget"))).alias("score"))


@query("""SELECT event_id, CASE WHEN value / 50 >= 1 THEN 'carries' WHEN value / 50 < 0.1 THEN 'does not' ELSE 'partly' END AS carry, CASE WHEN value >= 95 THEN 'saturated' WHEN value <= 50 THEN 'starved' ELSE 'partial' END AS pool FROM events""")
def b20_carry_verdict(spark, sf):
    return t.table(spark, sf, "events").select("event_id", sc.carry_verdict(F.col("value") / 50).alias("carry"), sc.pool_verdict(F.col("value")).alias("pool"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN 250 + o_custkey % 100 >= 308 AND o_orderkey % 2 > 0 OR 250 + o_custkey % 100 > 288 AND o_orderkey % 3 > 0 THEN 'at risk' ELSE 'invariant' END AS risk FROM orders""")
def b21_seam_risk(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", sc.seam_risk(F.when(F.col("o_orderstatus") != "P", 250 + F.col("o_custkey") % 100), F.col("o_orderkey") % 2, F.col("o_orderkey") % 3).alias("risk"))


@query("""SELECT p_partkey AS slug, p_name, p_brand FROM part WHERE lower(p_type) = 'economy' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_name <> ''""")
def b22_catalogue_filter(spark, sf):
    slugs = t.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("slug"))
    return sc.catalogue_filter(t.table(spark, sf, "part").withColumnRenamed("p_partkey", "slug"), slugs, hero="p_name", p_type="Economy").select("slug", "p_name", "p_brand")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR CASE WHEN o_orderkey % 4 = 0 THEN o_custkey * 10 * 4 + 10 ELSE o_orderkey END = o_custkey * 10 * 4 + 10 THEN 'input' ELSE 'payload' END AS kind FROM orders""")
def b23_bytes_kind(spark, sf):
    size = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") * 40 + 10).otherwise(F.col("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey", sc.bytes_kind(F.col("o_orderstatus") == "P", size, F.col("o_custkey"), F.lit(10)).alias("kind"))
