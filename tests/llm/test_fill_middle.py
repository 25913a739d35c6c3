"""Fill-in-the-middle: the skip list against prefix sums, the operator against a plain rendering with a regular expression, and edge cases."""

import hashlib
import random
import re

import numpy as np
from fleetlens.llm.fill_middle import SkipList, fill_in_middle, restored, token_widths
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 8, 9, 33, 1000, 20_000):
        widths = rng.integers(1, 9, n)
        tokens, sums = SkipList(widths), [0, *np.cumsum(widths).tolist()]
        assert [tokens.offset(r) for r in range(0, n + 1, 1 + n // 500)] == sums[:: 1 + n // 500]
        assert tokens.offset(n) == sums[n]
    lanes = [len(x[2]) for x in tokens.lanes]
    assert len(lanes) > 5 and all(0.15 * a < b < 0.4 * a for a, b in zip(lanes, lanes[1:4], strict=False))  # each lane is about a quarter of the one below


def test_tokens_equal_the_pattern():
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choices(" \t\n\x0b\x0c\r\x1c\x85\xa0 aé🎉<P>", k=random.randrange(30)))
        assert token_widths(text).tolist() == [len(t) for t in TOKEN.findall(text)]


def test_against_a_plain_rendering(spark):
    random.seed(5)
    texts = ["".join(random.choices("  \n\tabcé🎉<>PSM\xa0", weights=[9, 9, 2, 1, *[5] * 3, 1, 1, 1, 1, 1, 1, 1, 1], k=random.randrange(200))) for _ in range(600)]
    texts += [None, "", " ", "\n\n", "one", "x <M> y", "<", "P>", "< S >", "word " * 200_000, "é" * 100_000, " " * 50_000]
    rows = [(i, t, i, "kept") for i, t in enumerate(texts * 2)] + [(None, "of no id, all the same", 1, "a"), (3, texts[3], 3, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, form_ string")
    out = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "form_", "n_tokens", "form", "prefix_chars", "middle_chars", "output", "back"]
    key = lambda r: tuple((x is not None, x) for x in r)
    kept = out.collect()
    got = sorted(((r.doc_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output) for r in kept), key=key)
    assert got == sorted(((d, *plain_cut(d, t)) for d, t, *_ in rows), key=key)
    assert all(r.back == (r.text or "") for r in kept)
    assert {r.form for r in kept} == {"plain", "spm", "psm"}


def test_shares_and_empty_table(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words in a row").alias("text"))
    n = {r.form: r["count"] for r in fill_in_middle(docs, percent=30, spm_percent=50).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2800) < 150 and abs(n["spm"] - n["psm"]) < 150
    assert fill_in_middle(docs.limit(0)).count() == 0
