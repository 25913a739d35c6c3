"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .tokens import tokenizer_path


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True, shorter=240)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, half_keys=10)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats, text_parts

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(rows.unionByName(probe).withColumn("parts", text_parts(F.col("text"))))
    back = read_chats(chats)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    out = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), out, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, out)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, pool, score, train, word_vectors

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pooled = stored(pool(docs, word_vectors(docs)).drop("text"), "pooled")
    model = train(pooled, table(spark, sf_dir, "labels"))
    return score(pooled, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20; nulls read as one space."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", read("conv_id"), read("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair, repaired, summary, text_digests

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edits = stored(repair(damaged(rows)), "edits")
    out = rows.select(F.col("conv_id").alias("_id")).distinct()
    for part in (summary(edits), text_digests(repaired(edits))):
        out = out.join(part, F.col("_id").eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_tokens").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_nearest, op2_suffix_dedup, op3_near_duplicates, op4_chat_format, op5_best_fit_packing, op6_html_text, op7_substring_dedup, op8_token_files, op9_decontamination, op10_toxicity, op11_quality, op12_repair, op13_fill_in_middle)}

ORACLE: dict[str, str] = {
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
             w AS (SELECT r, unnest(range(1, octet_length(b) - 398)) AS p, b FROM d WHERE octet_length(b) >= 400),
             k AS (SELECT r, p, md5(b[p:p + 399]) AS h FROM w),
             m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
             s AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM k JOIN m USING (h)),
             g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM s),
             x AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY r, run),
             t AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM x GROUP BY r),
             y AS (SELECT r, a, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS z FROM x),
             k2 AS (SELECT r, p, md5(b[p:p + 239]) AS h FROM (SELECT r, unnest(range(1, octet_length(b) - 238)) AS p, b FROM d WHERE octet_length(b) >= 240)),
             s2 AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) - p AS gap FROM k2 JOIN (SELECT h FROM k2 GROUP BY h HAVING count(*) > 1) USING (h)),
             v AS (SELECT r, sum(least(240, coalesce(gap, 240))) AS n_repeated FROM s2 GROUP BY r),
             q AS (SELECT y.r, string_agg(hex(b[y.z:y.a - 1]), '' ORDER BY y.a) AS kept FROM y JOIN d USING (r) WHERE y.a > y.z GROUP BY y.r)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(CASE WHEN t.r IS NULL THEN b ELSE from_hex(coalesce(kept, '') || CASE WHEN last <= octet_length(b) THEN hex(b[last:octet_length(b)]) ELSE '' END) END) AS kept_sha256,
               coalesce(n_repeated, 0)::BIGINT AS n_repeated
        FROM d LEFT JOIN t USING (r) LEFT JOIN q USING (r) LEFT JOIN v USING (r)""",
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS sh
                   FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
                   GROUP BY 1, 2),
             e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
             r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.seen)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(seen) AS low FROM r GROUP BY id) c ON c.id = d.doc_id""",
    "op6_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS art FROM pages),
             b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(art, '</?(?:p|h1)>'),
                          lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'),
                          '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
        SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b""",
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
             k AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS seq FROM win),
             m AS (SELECT seq, min(doc_id) AS first FROM k GROUP BY seq),
             hit AS (SELECT k.doc_id, list(DISTINCT p + i) AS gone
                     FROM k JOIN m USING (seq), range(13) AS r(i) WHERE k.doc_id > first GROUP BY k.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN ws
                      ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN hit USING (doc_id)""",
    "op4_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
             e AS (SELECT *, replace(replace(text, '\', '\s'), '<', '\l') AS content,
                          replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS name FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, content), '')) AS loss_sha256,
               sum(length(content) + length(name) + 16)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ws,
                          sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
             d AS (SELECT *, len(ws) AS n, ('0x' || h[1:8])::BIGINT % (len(ws) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(ws) + 1) AS y,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                               WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
             c AS (SELECT *, array_to_string(ws[1:least(x, y)], '') AS p, array_to_string(ws[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(ws[greatest(x, y) + 1:], '') AS s FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM c""",
    "op12_repair": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                 string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM conversations),
             d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE h <> 0),
             n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), copy) AS i FROM d),
             f AS (SELECT conv_id AS c, i, turn, role, text, left(role, 1) AS ini, count(*) OVER (PARTITION BY conv_id) AS n,
                          CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM n),
             g AS (SELECT *, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::BIGINT AS cut,
                          CASE ini WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS keep FROM f),
             b(c, i, v) AS (SELECT DISTINCT c, n + 1, [0, 4, 2, 0]::BIGINT[] FROM g UNION ALL
                 SELECT c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
                   SELECT g.c, g.i, list_transform([1, 2, 3, 4], lambda q: least(3 + v[q], CASE WHEN must THEN 1000000000 ELSE 2 + cut + v[[3, 3, 4, 3][q]] END,
                          CASE WHEN must OR keep[q] = 0 THEN 1000000000 ELSE cut + v[keep[q]] END)) AS w FROM b JOIN g ON g.c IS NOT DISTINCT FROM b.c AND g.i = b.i - 1)),
             t(c, i, q, audit, lines) AS (SELECT DISTINCT c, 1::BIGINT, 1, '', []::VARCHAR[] FROM g UNION ALL
                 SELECT c, CASE x WHEN 'I' THEN i ELSE i + 1 END, CASE x WHEN 'D' THEN q WHEN 'K' THEN keep[q] ELSE [3, 3, 4, 3][q] END, audit || x,
                        CASE x WHEN 'D' THEN lines ELSE list_append(lines, CASE WHEN x = 'K' THEN role WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE x WHEN 'I' THEN '' ELSE text END) END FROM (
                   SELECT t.*, g.role, g.text, g.keep, CASE WHEN y.v[q] = 3 + z.v[q] THEN 'D' WHEN y.v[q] = 2 + y.v[[3, 3, 4, 3][q]] THEN 'I'
                          WHEN NOT must AND keep[q] > 0 AND y.v[q] = cut + z.v[keep[q]] THEN 'K' ELSE 'R' END AS x
                   FROM t JOIN b y ON y.c IS NOT DISTINCT FROM t.c AND y.i = t.i LEFT JOIN b z ON z.c IS NOT DISTINCT FROM t.c AND z.i = t.i + 1
                   LEFT JOIN g ON g.c IS NOT DISTINCT FROM t.c AND g.i = t.i WHERE z.v IS NOT NULL OR y.v[q] > 0)),
             s AS (SELECT t.c, t.audit, sha256(array_to_string(t.lines, chr(10))) AS hash FROM t JOIN (SELECT DISTINCT c, n FROM g) m ON m.c IS NOT DISTINCT FROM t.c AND t.i = m.n + 1 WHERE t.q IN (1, 4)),
             a AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
                   FROM (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS prev FROM g) GROUP BY c)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON a.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN s ON s.c IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN b ON b.c IS NOT DISTINCT FROM o.conv_id AND b.i = 1""",
}
