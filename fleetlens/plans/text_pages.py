"""Queries over pages, documents and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import text as op
from ..sources import text as src
from . import tables as t
from .quality import _HOLES, holes
from .registry import query

_REFS = r"""refs AS (SELECT page_id, url, (i - 1)::INT AS n, r[i] AS ref FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?:href|src)\s*=\s*["'']([^"'']+)["'']', 1) AS r FROM pages)))"""


@query(f"WITH {_REFS} SELECT page_id, url, n, ref FROM refs")
def a7_scan_pages(spark, sf):
    return src.scan_pages(t.table(spark, sf, "pages"))


_FENCED = "CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(10) || '```' || chr(10)) ELSE replace(text, ' th', ' `th` ') END"


@query(f"""WITH l AS (SELECT doc_id, i AS line_no, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split({_FENCED}, chr(10)) AS ls FROM documents))),
 f AS (SELECT *, regexp_matches(l, '^\\s*(```|~~~)') AS f, sum(regexp_matches(l, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS n, string_split(l, '`') AS p FROM l)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN f OR n % 2 = 1 THEN '' WHEN len(p) % 2 = 1 THEN array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(x)) ELSE x END), ' ') ELSE l END AS text FROM f""")
def a9_scan_lines(spark, sf):
    body = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\n```\n"))).otherwise(F.replace("text", F.lit(" th"), F.lit(" `th` ")))
    return src.scan_lines(t.table(spark, sf, "documents").select("doc_id", body.alias("text")), "doc_id", "text")


@query(f"""WITH {_REFS}, l AS (SELECT page_id, n, ref, ltrim(regexp_replace(ref, '[?#].*$', ''), '/') AS target FROM refs WHERE NOT regexp_matches(ref, '^([A-Za-z][A-Za-z0-9+.-]*:|//|#)')), f AS (SELECT DISTINCT ltrim(ref, '/') AS p FROM refs WHERE page_id % 3 = 0)
SELECT page_id, n, target FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE p = target)""")
def c13_dead_links(spark, sf):
    """All links; what every third page refers to stands in for the files that exist."""
    links = src.scan_pages(t.table(spark, sf, "pages")).withColumn("folder", F.lit("site"))
    files = links.filter("page_id % 3 = 0").select(op.resolve(F.lit("site"), F.col("ref")).alias("path")).distinct()
    return op.dead_links(links, files, "folder", "ref", "path").select("page_id", "n", "target")


@query("""SELECT concat_ws('-', length(text), len(string_split(text, ' '))) AS signature, count(DISTINCT lang) AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1""")
def d66_distinct_or_collide(spark, sf):
    """Texts are signed by their characters and words; texts of several languages share a signature here and there."""
    signature = F.concat_ws("-", F.char_length("text"), F.size(F.split("text", " ")))
    return op.distinct_or_collide(t.table(spark, sf, "documents").select(signature.alias("signature"), "lang"), "signature", "lang")


@query(rf"""WITH {_REFS}, o AS (SELECT *, regexp_replace(regexp_replace(ref, '[?#].*$', ''), '(-p-\d+)?(\.[A-Za-z]{{2,5}})?$', '') AS original FROM refs) SELECT page_id % 10 AS g, original, arg_min(ref, page_id * 1000 + n) AS ref, count(*) AS variants FROM o GROUP BY 1, 2""")
def g4_dedupe_refs(spark, sf):
    refs = src.scan_pages(t.table(spark, sf, "pages")).select((F.col("page_id") % 10).alias("g"), "ref", (F.col("page_id") * 1000 + F.col("n")).alias("o"))
    return op.dedupe_refs(refs, "g", "ref", "o")


@query(r"WITH h AS (SELECT doc_id, list_distinct(regexp_extract_all(" + _HOLES + r""", '\{(\w+)\}', 1)) AS i FROM documents), j AS (SELECT a.doc_id, list_sort(list_filter(a.i, lambda x: NOT list_contains(b.i, x))) AS d, list_sort(list_filter(b.i, lambda x: NOT list_contains(a.i, x))) AS v FROM h a JOIN h b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, array_to_string(d, ',') AS dropped, array_to_string(v, ',') AS invented FROM j WHERE len(d) > 0 OR len(v) > 0""")
def g2_key_difference(spark, sf):
    h = t.table(spark, sf, "documents").select("doc_id", sc.placeholders(holes()).alias("i"))
    out = op.key_difference(h, h.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "i")
    return out.select("doc_id", F.array_join("dropped", ",").alias("dropped"), F.array_join("invented", ",").alias("invented"))


@query("""WITH h AS (SELECT lang, (doc_id // 4)::VARCHAR AS key, list_sort(list_distinct(list(CASE doc_id % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'few' ELSE 'other' END))) AS have FROM documents GROUP BY 1, 2),
 w AS (SELECT lang, list_sort(list(DISTINCT form)) AS want FROM (SELECT DISTINCT lang, unnest(CASE WHEN lang IN ('en', 'de') THEN ['one', 'other'] ELSE ['few', 'one', 'other'] END) AS form FROM documents) GROUP BY 1)
SELECT lang, key, array_to_string(have, ',') AS have, array_to_string(want, ',') AS want FROM h JOIN w USING (lang) WHERE have <> want""")
def q5_plural_forms(spark, sf):
    d = t.table(spark, sf, "documents")
    packs = d.select("lang", F.expr("doc_id div 4").cast("string").alias("key"), F.when(F.col("doc_id") % 4 == 0, "one").when(F.col("doc_id") % 4 == 1, "few").otherwise("other").alias("form"))
    rules = d.select("lang").distinct().select("lang", F.explode(F.when(F.col("lang").isin("en", "de"), F.array(F.lit("one"), F.lit("other"))).otherwise(F.array(F.lit("one"), F.lit("few"), F.lit("other")))).alias("form"))
    return op.plural_forms(packs, rules).select("lang", "key", F.array_join("have", ",").alias("have"), F.array_join("want", ",").alias("want"))


@query("""WITH d AS (SELECT DISTINCT replace(p_name, ' ', '.') AS key FROM part WHERE p_size < 3), a AS (SELECT DISTINCT replace(p_name, ' ', '.') AS key FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || '.' FROM part UNION SELECT DISTINCT p_brand || '.' FROM part)
SELECT key FROM a WHERE CASE WHEN key LIKE '%.' THEN NOT EXISTS (SELECT 1 FROM d WHERE starts_with(d.key, a.key)) ELSE NOT EXISTS (SELECT 1 FROM d WHERE d.key = a.key) END""")
def q6_dynamic_keys(spark, sf):
    p = t.table(spark, sf, "part")
    key = F.replace("p_name", F.lit(" "), F.lit("."))
    asked = p.select(key.alias("key")).union(p.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".")))).union(p.select(F.concat("p_brand", F.lit(".")))).distinct()
    return op.dynamic_keys(asked, p.filter("p_size < 3").select(key.alias("key")), "key")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'not listed' WHEN d.doc_id IS NULL THEN 'no file' WHEN l.doc_id % 11 = 0 THEN 'unnamed' WHEN (quality = 1) = (toxic = 0) THEN 'draft xor stable' ELSE 'ok' END AS status
FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0) d USING (doc_id)""")
def q7_catalogue_status(spark, sf):
    """All labels against documents but for every seventh, so that entries without files occur."""
    index = t.table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.lit("n")).alias("name"), (F.col("quality") == 1).alias("draft"), (F.col("toxic") == 0).alias("stable"))
    return op.catalogue_status(index, t.table(spark, sf, "documents").filter("doc_id % 7 > 0"), "doc_id")


def _folded(x: str) -> str:
    return rf"trim(regexp_replace(translate(strip_accents(lower({x})), 'łđøħŧı', 'ldohti'), '[-‐-― \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""WITH s AS (SELECT doc_id, {_folded("text")} AS f FROM documents WHERE doc_id % 2 = 0), x AS (SELECT doc_id - 1 AS doc_id, lang, {_folded("text")} AS f FROM documents WHERE doc_id % 2 = 1),
 g AS (SELECT term, {_folded("term")} AS g FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part UNION ALL SELECT unnest(['the', 'und', 'de la', 'los']))),
 w AS (SELECT DISTINCT s.doc_id, lang, term, g, x.f FROM s JOIN x USING (doc_id), g WHERE regexp_matches(s.f, '(^|[^\p{{L}}\p{{N}}])' || g))
SELECT doc_id, lang, term FROM w WHERE NOT regexp_matches(f, '(^|[^\p{{L}}\p{{N}}])' || g)""")
def q8_keep_terms(spark, sf):
    """Each document of an even id stands in for a source text and the next one for its translation."""
    d = t.table(spark, sf, "documents")
    source, target = d.filter("doc_id % 2 = 0").select("doc_id", "text"), d.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "lang", "text")
    words = t.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct()
    langs = d.select("lang").distinct()
    extra = langs.select(F.explode(F.array(*[F.lit(x) for x in ("the", "und", "de la", "los")])).alias("term")).distinct()
    glossary = words.union(extra).select("term", F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es"))).alias("lang"), F.upper("term").alias("form"))
    return op.keep_terms(source, target, glossary, "doc_id", "text")


@query("""WITH k AS (SELECT DISTINCT p_partkey, replace(p_name, ' ', '-') AS name, split_part(p_name, ' ', 1) AS h1, split_part(p_name, ' ', 2) AS h2, p_size FROM part),
 c AS (SELECT DISTINCT l_partkey + 3 AS p_partkey FROM lineitem WHERE l_quantity > 30),
 g AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part WHERE p_size > 25),
 b AS (SELECT k.* FROM k JOIN c USING (p_partkey)),
 h AS (SELECT p_partkey, unnest(list_distinct([h1, h2])) AS hole, h1, h2 FROM b)
SELECT p_partkey, 'unexplained' AS problem, NULL::VARCHAR AS detail FROM k WHERE p_partkey NOT IN (SELECT p_partkey FROM c)
 UNION ALL SELECT p_partkey, 'stale', NULL FROM c WHERE p_partkey NOT IN (SELECT p_partkey FROM k)
 UNION ALL SELECT p_partkey, 'nowhere', NULL FROM b WHERE p_partkey % 5 = 0
 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'empty' ELSE 'undescribed' END, hole FROM h WHERE hole = h2 AND h2 <> h1 AND p_partkey % 3 < 2
 UNION ALL SELECT p_partkey, 'unknown term', h2 FROM b WHERE h2 NOT IN (SELECT term FROM g)""")
def q9_context_coverage(spark, sf):
    """Keys are parts, their texts hold the two words of the name as placeholders; contexts are made of line items."""
    part = t.table(spark, sf, "part")
    words = [F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]
    keys = part.select("p_partkey", F.concat(F.lit("{"), words[0], F.lit("} of {"), words[1], F.lit("}")).alias("text"))
    made = t.table(spark, sf, "lineitem").filter("l_quantity > 30").select((F.col("l_partkey") + 3).alias("p_partkey")).distinct().join(part.select("p_partkey", "p_name"), "p_partkey", "left")
    second = F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 2, "what it is")
    said = F.map_from_entries(F.array_distinct(F.array(F.struct(words[0].alias("k"), F.lit("said").alias("v")), F.struct(F.when(words[1] == words[0], F.concat(words[1], F.lit("?"))).otherwise(words[1]).alias("k"), second.alias("v")))))
    context = made.select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, "a panel").alias("where"), F.when(F.col("p_name").isNotNull(), said).alias("placeholders"), F.array(words[1]).alias("terms"))
    return op.context_coverage(keys, context, part.filter("p_size > 25").select(words[1].alias("term")).distinct(), "p_partkey")
