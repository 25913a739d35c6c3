"""Links, references, packs and glossaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_text, folded_starts, placeholders, strip_derivative


def resolve(folder: Column, ref: Column) -> Column:
    """A relative reference against its folder: "." and ".." folded, query and fragment dropped."""
    path = F.regexp_replace(ref, "[?#].*$", "")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)), "/")


def dead_links(links: DataFrame, files: DataFrame, folder: str, ref: str, path: str) -> DataFrame:
    """Links without a file: schemes and pure fragments are skipped, a folder needs its README.md."""
    own = links.filter(~F.col(ref).rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//|#)"))
    target = resolve(F.col(folder), F.col(ref))
    target = F.when(F.col(ref).rlike("/([?#].*)?$"), F.concat_ws("/", F.nullif(target, F.lit("")), F.lit("README.md"))).otherwise(target)
    return own.withColumn("target", target).join(files.select(F.col(path).alias("_p")), F.col("target") == F.col("_p"), "left_anti")


def dedupe_refs(refs: DataFrame, group: str, ref: str, order: str) -> DataFrame:
    """One reference of each original (derivatives collapse), the first in order."""
    g = refs.withColumn("original", strip_derivative(F.col(ref))).groupBy(group, "original")
    return g.agg(F.min_by(ref, order).alias(ref), F.count("*").alias("variants"))


def distinct_or_collide(rows: DataFrame, signature: str, label: str) -> DataFrame:
    """Signatures that more than one label has."""
    return rows.groupBy(signature).agg(F.count_distinct(label).alias("labels")).filter("labels > 1")


def key_difference(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """Items of a key's array that the other side dropped or invented; only keys of both sides that differ."""
    j = a.select(key, F.col(items).alias("_a")).join(b.select(key, F.col(items).alias("_b")), key)
    j = j.select(key, F.array_sort(F.array_except("_a", "_b")).alias("dropped"), F.array_sort(F.array_except("_b", "_a")).alias("invented"))
    return j.filter((F.size("dropped") > 0) | (F.size("invented") > 0))


def plural_forms(packs: DataFrame, rules: DataFrame) -> DataFrame:
    """Plural keys whose forms are not exactly their language's categories (lang, form)."""
    want = rules.groupBy("lang").agg(F.array_sort(F.collect_set("form")).alias("want"))
    have = packs.filter("form is not null").groupBy("lang", "key").agg(F.array_sort(F.collect_set("form")).alias("have"))
    return have.join(want, "lang", "left").filter(~F.col("have").eqNullSafe(F.col("want")))


def dynamic_keys(asked: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """Asked keys that are not defined; one that ends in "." must begin at least one defined key. Prefixes are met by an equi-join on every
    prefix of the defined keys that ends in a dot."""
    d = defined.select(F.col(key).alias("_k"))
    parts = F.split("_k", "\\.")
    heads = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit(".")))).alias("_k")).filter(F.col("_k") != ".")
    plain = asked.filter(~F.col(key).endswith(".")).join(d, F.col(key) == F.col("_k"), "left_anti")
    prefix = asked.filter(F.col(key).endswith(".")).join(heads.distinct(), F.col(key) == F.col("_k"), "left_anti")
    return plain.unionByName(prefix)


def find_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, most_chars: int = 4_000_000) -> DataFrame:
    """(key, term) of all terms that a text holds, both folded already; Latin terms at the start of a word only, each once a text.

    One automaton (Aho-Corasick) finds all terms in a single pass over a text, also those that overlap or lie in one another. At most
    ``most_chars`` characters of terms are broadcast; a larger dictionary takes several passes. Null texts and empty terms match nothing."""
    known = terms.select(F.col(term).alias("term")).filter("term <> ''").distinct()
    total = known.agg(F.coalesce(F.sum(F.char_length("term")), F.lit(0)).alias("n")).first().n
    parts, out = max(1, -(-int(total) // most_chars)), None
    rows, kind = texts.select(key, F.col(text).alias("_t")), dict(texts.dtypes)[key]
    for part in range(parts):
        own = known.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        shared = texts.sparkSession.sparkContext.broadcast([r.term for r in own.collect()])  # about ``most_chars`` characters

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    held = {w for end, w in automaton.iter(t) if not "a" <= w[0] <= "z" or end < len(w) or not t[end - len(w)].isalnum()} if t and shared.value else ()
                    at += [i] * len(held)
                    found += sorted(held)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=[key, "term"])

        hits = rows.mapInArrow(scan, f"`{key}` {kind}, term string")
        out = hits if out is None else out.unionByName(hits)
    return out


def keep_terms(source: DataFrame, target: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, term) where the source text holds a kept term and the translation (key, lang, text) lacks the ruled form of its language
    (glossary: term, lang, form), both as ``folded_starts`` has it: words may go on after a term, as in an inflected form."""
    rules = glossary.select("term", "lang", fold_text(F.col("term")).alias("_g"), fold_text(F.col("form")).alias("_f"))
    has = find_terms(source.select(key, fold_text(F.col(text)).alias("_t")), key, "_t", rules, "_g").withColumnRenamed("term", "_g")
    j = has.join(rules, "_g").distinct().join(target.select(key, "lang", fold_text(F.col(text)).alias("_x")), [key, "lang"])
    return j.filter(~folded_starts(F.col("_x"), F.col("_f"))).select(key, "lang", "term")


def context_coverage(keys: DataFrame, context: DataFrame, glossary: DataFrame, key: str) -> DataFrame:
    """What a translator could not work from: (key, problem, detail). Keys (key, text) and their contexts (key, where, placeholders
    map<string,string>, terms array<string>) are met by key, cited terms by the glossary (term).

    Problems: unexplained, a key without a context; nowhere, a context that says not where its text stands; undescribed and empty, a
    placeholder of the text without a description or with a blank one; unknown term; stale, a context without a key. Details are
    the placeholder or term, else null."""
    k = keys.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(placeholders(F.col("text"))))).alias("_holes")).withColumn("_k", F.lit(True))
    j = k.join(context.select(key, "where", "placeholders", "terms", F.lit(True).alias("_c")), key, "full_outer")
    both = j.filter("_k and _c")
    none = F.lit(None).cast("string")
    hole = both.select(key, "placeholders", F.explode("_holes").alias("detail"))
    said = F.try_element_at("placeholders", F.col("detail"))
    cited = both.select(key, F.explode(F.array_distinct("terms")).alias("detail"))
    return (
        j.filter("_c is null or _k is null").select(key, F.when(F.col("_c").isNull(), "unexplained").otherwise("stale").alias("problem"), none.alias("detail"))
        .unionByName(both.filter(F.coalesce("where", F.lit("")) == "").select(key, F.lit("nowhere").alias("problem"), none.alias("detail")))
        .unionByName(hole.filter(F.coalesce(F.trim(said), F.lit("")) == "").select(key, F.when(F.coalesce(said, F.lit("")) == "", "undescribed").otherwise("empty").alias("problem"), "detail"))
        .unionByName(cited.join(glossary.select(F.col("term").alias("detail")), "detail", "left_anti").select(key, F.lit("unknown term").alias("problem"), "detail"))
    )


def catalogue_status(index: DataFrame, packs: DataFrame, key: str) -> DataFrame:
    """Index entries (key, name, draft, stable) against existing files: listed without a file, file not listed, unnamed, or draft and stable
    not exactly one; ok else."""
    p = packs.select(key).distinct().withColumn("_p", F.lit(True))
    j = index.withColumn("_i", F.lit(True)).join(p, key, "full_outer")
    status = F.when(F.col("_i").isNull(), "not listed").when(F.col("_p").isNull(), "no file").when(F.coalesce("name", F.lit("")) == "", "unnamed").when(F.coalesce("draft", F.lit(False)) == F.coalesce("stable", F.lit(False)), "draft xor stable").otherwise("ok")
    return j.select(key, status.alias("status"))
