"""Column functions: labels, rules, names and verdicts. Absent evidence gives null, never a default."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of a finish; the least length and number of spaces of prose, and the font families that give a style away.
FINISHES = ("honed", "polished", "leathered", "brushed")
PROSE_CHARS, PROSE_SPACES = 34, 5
GENERIC_FONTS = ("sans-serif", "ui-monospace", "monospace", "system-ui")
# Letters that have no decomposition, and what they fold to.
UNDECOMPOSED = {"ł": "l", "đ": "d", "ø": "o", "ħ": "h", "ŧ": "t", "ı": "i"}


def pixel_metrics(w: Column, h: Column, size: Column) -> list[Column]:
    """pixels (h defaults to round(w * 0.625)), gigapixels, bytes per pixel (0 where there are no pixels)."""
    px = w.cast("decimal(38,0)") * F.coalesce(h, F.round(w * 0.625).cast("bigint")).cast("decimal(38,0)")
    px = px.cast("decimal(38,0)")
    return [px.cast("bigint").alias("pixels"), (px.cast("double") / 1e9).alias("gigapixels"), F.when(px == 0, 0.0).otherwise(size / px.cast("double")).alias("bytes_per_pixel")]


def light_label(spectrum: Column, cross: Column) -> Column:
    """uv below 310, day from 390 on, spNNN between; a crossfade adds xA_B of its two-digit value."""
    base = F.when(spectrum < 310, "uv").when(spectrum >= 390, "day").otherwise(F.concat(F.lit("sp"), spectrum.cast("string")))
    return F.when(spectrum.isNull(), None).when(cross.isNotNull(), F.concat(base, F.lit("x"), F.replace(F.format_string("%.1f", cross), F.lit("."), F.lit("_")))).otherwise(base)


def by_rules(value: Column, rules: list[tuple[str, str]], basis: str) -> Column:
    """The name of the first pattern that the value matches, with the basis it rests on."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return F.struct(out.alias("name"), F.when(out.isNotNull(), basis).otherwise("nothing").alias("basis"))


def engine_of(engine: Column, agent: Column, file: Column, agent_rules: list[tuple[str, str]], file_rules: list[tuple[str, str]]) -> Column:
    """The recorded engine, else the first agent rule that matches, else the first file-name rule; with the basis."""
    a, f = by_rules(agent, agent_rules, "agent"), by_rules(file, file_rules, "name")
    return F.when(engine.isNotNull(), F.struct(engine.alias("name"), F.lit("recorded").alias("basis"))).when(a["name"].isNotNull(), a).otherwise(f)


def classify(rules: list[tuple[Column, str]]) -> Column:
    """The first rule that holds, null-safe: a rule over null does not hold."""
    return reduce(lambda out, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def build_key(build: Column, parts: int = 4) -> Column:
    """Numbers of a dotted build, missing ones 0: arrays that compare part by part. Parts without digits count as 0."""
    p = F.transform(F.split(build, "\\."), lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, "^([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    return F.when(build.isNotNull(), F.slice(F.concat(p, F.array_repeat(F.lit(0), parts)), 1, parts))


def build_gte(a: Column, b: Column) -> Column:
    return build_key(a) >= build_key(b)


def recorded_state(value: Column, build: Column, since: str) -> Column:
    """recorded, missing (the build should have it), or predates the field; unknown without a build."""
    return F.when(value.isNotNull(), "recorded").when(build.isNull(), "unknown").when(build_gte(build, F.lit(since)), "missing").otherwise("predates")


def parse_name(name: Column, pattern: str, fields: list[str]) -> list[Column]:
    """The groups of a file name's pattern as columns, null where it does not match."""
    return [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).alias(f) for i, f in enumerate(fields, 1)]


def canonical_name(*parts: Column) -> Column:
    """Parts in lower case joined by dashes, each cut to letters, digits and single underscores."""
    clean = [F.regexp_replace(F.regexp_replace(F.lower(p.cast("string")), "[^a-z0-9]+", "_"), "^_+|_+$", "") for p in parts]
    return F.concat_ws("-", *clean)


def render_verdict(mean: Column, lit40: Column, material: Column, marks: Column, *geometry: Column) -> Column:
    """BLACK FRAME, else NOTHING LIT, else EMPTY STONE (stone with marks and no geometry at all), else null."""
    none = reduce(lambda a, b: a & b, [g == 0 for g in geometry])
    return F.when(mean == 0, "BLACK FRAME").when(lit40 == 0, "NOTHING LIT").when((material == "stone") & (marks > 0) & none, "EMPTY STONE")


def split_path(path: Column) -> tuple[Column, Column]:
    """Folder and name, by either kind of slash."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "").alias("folder"), name.alias("name")


def state_signature(*fields: Column) -> Column:
    """Lower-case hex CRC32 of the fields as JSON in their order; null where all are null."""
    known = reduce(lambda a, b: a | b, [f.isNotNull() for f in fields])
    return F.when(known, F.lower(F.hex(F.crc32(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary")))))


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1)))


def has_entity(text: Column) -> Column:
    return text.rlike(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def has_prose(text: Column) -> Column:
    """Reads like a sentence: long enough and of enough words, a word of three small letters begins or goes on in its first line, it does not
    start with a digit, and holds no markup, template braces or generic font family. Whether it is a known key is a join for the caller."""
    words = F.size(F.split(text, " ")) > PROSE_SPACES
    bare = F.translate(text, "<>{}", "") == text
    small = F.split_part(text, F.lit("\n"), F.lit(1)).rlike("[a-z][a-z][a-z]")
    styled = text.rlike(rf"\b(?:{'|'.join(GENERIC_FONTS)})\b")
    return words & (F.char_length(text) >= PROSE_CHARS) & small & bare & ~F.substring(text, 1, 1).between("0", "9") & ~styled


def lint_terms(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Hits of a dictionary of words (term, better): an equi-join on the words of each text, so that neither side need be small."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))).alias("term"))
    return words.join(dictionary, "term").select(key, "term", "better")


def _base_letters() -> tuple[str, str]:
    """Small letters with marks and the letters under the marks, by Unicode's own decomposition."""
    letters = dict(UNDECOMPOSED)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and len(base[0].lower()) == 1 and all(unicodedata.combining(c) for c in base[1:]):
            letters[chr(code)] = base[0]
    return "".join(letters), "".join(letters.values())


def fold_text(text: Column) -> Column:
    """Without case and marks on letters (also as characters of their own); hyphens and white space between words are one space, as a term is
    the same with any of them."""
    plain = F.regexp_replace(F.translate(F.lower(text), *_base_letters()), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(plain, r"[-\u2010-\u2015\s]+", " "))


def folded_starts(folded: Column, term: Column) -> Column:
    """A folded text holds a folded term: at the start of a word if the term begins with a Latin letter, anywhere else, as other scripts
    have no spaces between words."""
    at_word = F.regexp_like(folded, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E")))
    return F.when(term.rlike("^[a-z]"), at_word).otherwise(F.contains(folded, term))


def starts_word(text: Column, term: str) -> Column:
    """The folded text holds the term as ``folded_starts`` has it."""
    return folded_starts(fold_text(text), fold_text(F.lit(term)))


def lean_deg(tilt_x: Column, tilt_y: Column, altitude: Column) -> Column:
    """Degrees from upright of a pen by its tilts, else by its altitude."""
    t = F.hypot(F.tan(F.radians(tilt_x)), F.tan(F.radians(tilt_y)))
    return F.coalesce(90 - F.degrees(F.atan2(F.lit(1.0), t)), 90 - F.degrees(altitude))


def strip_derivative(url: Column) -> Column:
    """Without query, size suffix -p-NNN and extension."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(-p-\d+)?(\.[A-Za-z]{2,5})?$", "")


def slab_inches(name: Column) -> tuple[Column, Column]:
    at = lambda i: F.nullif(F.regexp_extract(name, r"(\d{2,3})\s*[xX]\s*(\d{2,3})", i), F.lit("")).cast("int")
    return at(1).alias("inches_w"), at(2).alias("inches_h")


def finish(name: Column) -> Column:
    """The first word of a finish in the name, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(name), "|".join(FINISHES), 0), F.lit(""))


def name_tokens(slug: Column, stop: list[str]) -> Column:
    """Words of at least four letters that are no stop words; the stop words among them too where no other is left."""
    long = F.filter(F.split(F.lower(slug), "[^a-z0-9]+"), lambda x: F.char_length(x) >= 4)
    kept = F.filter(long, lambda x: ~x.isin(stop))
    return F.when(F.size(kept) > 0, kept).otherwise(long)


def token_score(tokens: Column, name: Column) -> Column:
    """How many tokens the name holds, letters and digits only."""
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.size(F.filter(tokens, lambda x: F.contains(flat, x)))


def carry_verdict(carry: Column) -> Column:
    return F.when(carry >= 1, "carries").when(carry < 0.1, "does not").when(carry.isNotNull(), "partly")


def pool_verdict(percent: Column) -> Column:
    return F.when(percent >= 95, "saturated").when(percent <= 50, "starved").when(percent.isNotNull(), "partial")


def seam_risk(spectrum: Column, bloom: Column, sigma: Column) -> Column:
    """At risk from 308 on with bloom or above 288 with sigma, invariant else, unknown where a setting is missing."""
    unknown = spectrum.isNull() | bloom.isNull() | sigma.isNull()
    return F.when(unknown, "unknown").when((spectrum >= 308) & (bloom > 0) | (spectrum > 288) & (sigma > 0), "at risk").otherwise("invariant")


def catalogue_filter(items: DataFrame, slugs: DataFrame | None = None, limit: int | None = None, hero: str | None = None, **equal: str) -> DataFrame:
    """Items whose columns equal the given values without regard to case, whose slug is among ``slugs`` and whose hero is not empty."""
    for c, v in equal.items():
        items = items.filter(F.lower(F.col(c)) == v.lower())
    if hero is not None:
        items = items.filter(F.coalesce(F.col(hero), F.lit("")) != "")
    if slugs is not None:
        items = items.join(slugs.select("slug"), "slug", "left_semi")
    return items if limit is None else items.orderBy("slug").limit(limit)


def bytes_kind(streamed: Column, size: Column, w: Column, h: Column) -> Column:
    """input where streamed or exactly w * h * 4 + h bytes, else payload."""
    return F.when(F.coalesce(streamed, F.lit(False)) | size.eqNullSafe(w * h * 4 + h), "input").when(size.isNotNull(), "payload")


def to_index_row(renders: DataFrame, flat: dict[str, str], flags: list[str] = ()) -> DataFrame:
    """A flat row of a nested record: column name to path; ``flags`` become booleans. Missing paths become null columns."""
    known = renders.columns
    pick = lambda path: F.col(path) if path.split(".")[0] in known else F.lit(None).cast("string")
    return renders.select(*[(pick(p).cast("boolean") if n in flags else pick(p)).alias(n) for n, p in flat.items()])
