"""Text sources: catalogue pages, message packs, document lines, stroke files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Image and link references of each page, in order: key, url, n (from 0), ref. Null pages have none."""
    refs = F.regexp_extract_all(html, F.lit(r"""(?:href|src)\s*=\s*["']([^"']+)["']"""), 1)
    return pages.select(key, url, F.posexplode(refs).alias("n", "ref"))


def scan_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines (key, line_no from 1, text) with code blanked: lines of a fenced block are empty, inline code becomes as many spaces. The fence
    state is a running count over the lines of one document."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "_l"))
    fence = F.col("_l").rlike("^\\s*(```|~~~)").cast("int")
    w = Window.partitionBy(key).orderBy("_p")
    lines = lines.withColumns({"_f": fence, "_n": F.sum(fence).over(w)})
    inside = (F.col("_f") == 1) | (F.col("_n") % 2 == 1)
    parts = F.split("_l", "`")
    shown = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.char_length(x))).otherwise(x)), " ")
    return lines.select(key, (F.col("_p") + 1).alias("line_no"), F.when(inside, "").when(F.size(parts) % 2 == 1, shown).otherwise(F.col("_l")).alias("text"))


def scan_packs(spark: SparkSession, path: str) -> DataFrame:
    """Message packs (one JSON object a file, named by language) as (lang, key, form, text): plural objects give a row per form, plain texts
    the form null; files whose name begins with "_" are left out, unreadable ones give no rows."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    raw = spark.read.text(path, wholetext=True).select(name.alias("lang"), F.from_json("value", "map<string,string>").alias("m")).filter(~F.col("lang").startswith("_"))
    rows = raw.select("lang", F.explode("m").alias("key", "_v"))
    forms = F.when(F.col("_v").startswith("{"), F.from_json("_v", "map<string,string>"))
    plain = rows.filter(forms.isNull()).select("lang", "key", F.lit(None).cast("string").alias("form"), F.col("_v").alias("text"))
    plural = rows.withColumn("_f", forms).filter("_f is not null").select("lang", "key", F.explode("_f").alias("form", "text"))
    return plain.unionByName(plural)


def scan_strokes(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Strokes (nested arrays of [x, y, t]) as (key, stroke, seq, x, y, t); points of another length are left out."""
    s = docs.select(key, F.posexplode(F.from_json(body, "array<array<array<double>>>")).alias("stroke", "_s"))
    p = s.select(key, "stroke", F.posexplode("_s").alias("seq", "_p")).filter(F.size("_p") == 3)
    return p.select(key, "stroke", "seq", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), F.col("_p")[2].alias("t"))
