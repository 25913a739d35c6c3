"""Leaks against a brute-force search by edit distance."""

import random

import numpy as np
from fleetlens.llm.decontaminate import align, decontaminate, fewest_edits, find_leaks, normal


def brute(segment, text, k):
    """Fewest edits of ``segment`` against any stretch of ``text``, None if more than k."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if min(row) <= k else None


def edit(text, n, rng):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        rng.choice([lambda: t.pop(at), lambda: t.insert(at, "q"), lambda: t.__setitem__(at, "z")])()
    return "".join(t)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(0, text(12)), (1, text(25)), (2, text(40)), (3, "Abc de"), (4, None), (5, "")]
    docs = [(i, text(60)) for i in range(20)]
    for i in range(40):
        item = items[i % 3][1]
        docs.append((100 + i, text(15) + "\n " + edit(item, rng.randint(0, 6), rng).upper() + "  " + text(rng.randint(0, 20))))
    docs += [(200, None), (201, ""), (202, "xx abc  DE yy"), (203, items[0][1]), (203, items[0][1])]
    d = spark.createDataFrame([(*x, "w", 1) for x in docs], "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_segments, r.edits) for r in find_leaks(d, b, segment=60).collect())
    want = []
    for doc_id, raw in docs:
        t = normal(raw or "")
        for item_id, item in items:
            s = normal(item or "")
            if not s:
                continue
            starts = [0] if len(s) <= 60 else [*range(0, len(s) - 60, 30), len(s) - 60]
            own = []
            for at in starts:
                part = s[at : at + 60]
                k = max(0, min(int(0.05 * len(part)), (len(part) - 12) // 12))
                e = (0 if part in t else None) if len(part) < 12 else brute(part, t, k)
                own += [e] if e is not None else []
            if own:
                want.append((doc_id, item_id, len(own), min(own)))
    assert len(want) > 20 and got == sorted(want)
    kept = decontaminate(d, b, segment=60)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in docs} - {x[0] for x in want}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, b).count() == 0
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert find_leaks(full, b).count() == 0 and decontaminate(full, b).count() == 1


def test_stretches_at_any_offset(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60))[:233].strip() + "x"
    other = lambda n: " ".join("".join(rng.choices("mnopqrst", k=5)) for _ in range(n))
    docs = [(i, f"{other(6)} {item[i : i + 100]} {other(6)}") for i in range(len(item) - 99)]  # each offset, as exact text
    docs += [(1000, f"{other(5)}{item[10:140]}{other(5)}"), (1001, f"{other(6)} {item[20:60]}zz{item[62:130]} {other(6)}"), (1002, f"{other(6)} {item[15:95]} {other(6)}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in find_leaks(d, b).collect()}
    assert set(rows) == {i for i, _ in docs} - {1002} and all(r.item_id == 7 for r in rows.values())
    assert rows[1000].n_segments == 0 and rows[1000].edits == 0 and rows[1001].edits == 2
    assert {r.doc_id for r in decontaminate(d, b).collect()} == {1002}


def test_fewest_edits_are_those_of_align():
    rng = random.Random(9)
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for _ in range(60):
        item = "".join(rng.choices("abc", k=60))
        text = ("".join(rng.choices("abc", k=rng.randint(0, 9))) + edit(item, rng.randint(0, 6), rng))[: rng.randint(30, 80)]
        starts, low, k = np.arange(21), rng.randint(-6, 9), 5
        got = fewest_edits(codes(item), codes(text), starts, 40, low, 12, k)
        for s, e in zip(starts, got, strict=True):
            want = align(item[s : s + 40], text, low + int(s), 12, k)
            assert want is not None and want[0] == e if e <= k else want is None


def test_a_very_long_text(spark):
    rng = random.Random(11)
    other = lambda n: " ".join("".join(rng.choices("mnopqrst", k=5)) for _ in range(n))
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(30))
    long = f"{other(120_000)} {item[:60]}y{item[61:]} {other(120_000)}"
    d = spark.createDataFrame([(1, long), (2, other(250_000)), (3, "a" * 1_000_000)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "bb" * 300)], "item_id long, text string")
    got = find_leaks(d, b).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and long[got[0].start : got[0].end].startswith(item[:50])
