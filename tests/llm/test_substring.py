"""Repeated word windows against brute force."""

import random

import pytest
from fleetlens.llm.common import WORD_RE
from fleetlens.llm.substring import pack_gaps, remove_repeats, unpack_gaps


def brute(docs, window):
    rows = [(i, WORD_RE.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (1, 0)), (i is None, i or 0))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i is None, i or 0):
                gone[p : p + window] = [True] * window
        out.append((i is None, i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 8, 22])
def test_against_brute_force(spark, bits):
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdeé") * rng.randint(1, 3) for _ in range(n)]
    shared = [words(n) for n in (5, 8, 30, 100)]
    docs = [(500, None), (501, ""), (502, "a b"), (None, " ".join(shared[2])), (7, " ".join(shared[3])), (7, " ".join(shared[3])), (503, "w " * 4000)]
    for i in range(60):
        t = words(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            t += s[rng.randint(0, 3) :] + words(rng.randint(0, 10))
        docs.append((i, "\n".join(t) if i % 2 else "  ".join(t)))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, f int, kept string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, window=6, bits=bits).collect())
    assert got == brute(docs, 6)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gaps():
    import numpy as np

    cells = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 3000))
    assert (unpack_gaps(pack_gaps(cells)) == cells).all() and unpack_gaps(pack_gaps(np.array([0]))).tolist() == [0]
    assert len(unpack_gaps(pack_gaps(np.empty(0, np.int64)))) == 0


def test_word_hashes():
    import random

    from fleetlens.llm.substring import word_hashes

    rng = random.Random(3)
    words = [bytes(rng.choices(b"abc\xc3\xa9", k=rng.choice((1, 2, 3, 5, 64, 65, 300)))) for _ in range(300)] + [b"x" * 70_000, b"y" * 140_000]
    known: dict[bytes, int] = {}
    for n in (0, 1, 5, 400, 3000):
        some = rng.choices(words, k=n)
        raw = b"".join(w + rng.choice((b" ", b"\n", b"\t \r", b"\x0b\x0c")) for w in some)
        for text in (raw, raw.strip(), b" " + raw):
            h = word_hashes(text).tolist()
            assert len(h) == n and all(known.setdefault(w, x) == x for w, x in zip(some, h, strict=True))
    assert len(set(known.values())) == len(known)
