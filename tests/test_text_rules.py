"""Folding, prose, finishes and embedded objects against plain Python."""

import json
import random
import unicodedata

import pytest
from fleetlens.functions import scalars as sc
from fleetlens.operators.text import find_terms
from fleetlens.sources.files import extract_from_tails, match_braces
from pyspark.sql import functions as F


def test_letters_fold_by_their_decomposition(spark):
    cases = {"ő": "o", "Ș": "s", "Łódź": "lodz", "été": "ete", "Ünïcödé": "unicode", "Việt Nam": "viet nam", "ğ-ı": "g i", "En-échelon": "en echelon", "토큰": "토큰", "हिन्दी": "हिन्दी", "ø": "o", "naïve  \t x": "naive  x", "日本": "日本", "": ""}
    got = {r.t: r.f for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", sc.fold_text(F.col("t")).alias("f")).collect()}
    assert got == cases
    letters = [chr(c) for c in range(0xC0, 0x250) if chr(c).islower()]
    folded = {r.t: r.f for r in spark.createDataFrame([(c,) for c in letters], "t string").select("t", sc.fold_text(F.col("t")).alias("f")).collect()}
    for c in letters:
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1:
            assert folded[c] == base[0]


def test_prose_and_finishes(spark):
    yes = "This reads like a sentence, and is one of length."
    no = ["short one of five words x", yes.upper(), "1 " + yes, yes + " <b>", yes + " {n}", "11px sans-serif and some more words of it, many", "nospacesatallinthisverylongstringofletters", "THE FIRST\n" + yes]
    rows = spark.createDataFrame([(yes, True), *((t, False) for t in no), (None, None)], "t string, want boolean")
    assert rows.filter(~sc.has_prose(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    names = {"Polished or Honed": "polished", "honed then POLISHED": "honed", "matte": None, "x-leathered": "leathered"}
    got = {r.n: r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", sc.finish(F.col("n")).alias("f")).collect()}
    assert got == names


def test_braces_in_strings():
    for text in ('{"a":"}{"}', '{"a\\"}":{"b":[{},"{"]}}', "{}", '{"é":"\\\\"}'):
        assert match_braces(text + " } tail", 0) == len(text)
    assert match_braces('{"a":"open } ', 0) == match_braces("{ {}", 0) == match_braces('{"a\\"}', 0) == -1


@pytest.mark.parametrize("step", [16, 61, 4096])
def test_tails_are_read_block_by_block(spark, tmp_path, step):
    random.seed(step)
    want = {}
    for i in range(12):
        found = {"n": i, "s": "}{\"é" * (i % 4), "pad": "x" * random.randrange(200)} if i % 5 else None
        body = "noise @@J: {bad " * random.randrange(4) + (f"@@J: {json.dumps(found, ensure_ascii=False)}" if found else "") + " tail @@J {" * random.randrange(3)
        path = tmp_path / f"{i}.bin"
        path.write_bytes(("é" * random.randrange(300)).encode() + body.encode())
        want[f"file://{path}"] = found
    got = extract_from_tails(spark.createDataFrame([(p,) for p in want], "path string"), "path", "@@J:", step=step).collect()
    assert {r.path: r.meta and json.loads(r.meta) for r in got} == want
    for r in got:
        if r.meta:
            assert open(r.path[7:], "rb").read()[r.start : r.end].decode() == r.meta


def test_terms_that_overlap(spark):
    """Every term at a word's start, also inside another one; of other scripts anywhere; dictionaries in several passes."""
    texts = [(1, "the slates of old slate beds"), (2, "translate the token"), (3, "이토큰은 좋다"), (4, None), (5, ""), (6, "old slate-bed a.b a-b")]
    words = ["slate", "old slate", "slate bed", "the", "old", "token", "토큰", "bed", "a.b", "", "isl"]
    t = spark.createDataFrame(texts, "id long, text string").select("id", sc.fold_text(F.col("text")).alias("t"))
    want = [(1, w) for w in ("bed", "old", "old slate", "slate", "slate bed", "the")] + [(2, "the"), (2, "token"), (3, "토큰")] + [(6, w) for w in ("a.b", "bed", "old", "old slate", "slate", "slate bed")]
    for most in (4_000_000, 12):
        got = find_terms(t, "id", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w", most).collect()
        assert sorted((r.id, r.term) for r in got) == sorted(want)
    folded = t.crossJoin(spark.createDataFrame([(w,) for w in words if w], "w string")).filter(sc.folded_starts(F.col("t"), F.col("w")))
    assert sorted((r.id, r.w) for r in folded.collect()) == sorted(want)
    assert find_terms(t, "id", "t", spark.createDataFrame([], "w string"), "w").count() == 0
