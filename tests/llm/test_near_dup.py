"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
from fleetlens.llm.components import components
from fleetlens.llm.near_dup import linked, near_duplicates


def brute(docs, percent=80):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = {i: i for i, _ in docs}
    find = lambda x: x if low[x] == x else find(low[x])
    for i, (a, _) in enumerate(docs):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(docs[j][0])))
                low[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(docs, sets, strict=True))


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeÉ", k=rng.randint(2, 6)))
    docs = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one two three"), (9006, "É a b c d e"), (9007, "é a b c d e")]
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 200))]
        for c in range(25 if g else 150):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            docs.append((g * 200 + c, " ".join(t)))
    docs += [(3000 + i, docs[20][1]) for i in range(5)]
    docs.append((5000, "long word list " * 60_000))
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, n long, h string")
    for block, percent in ((3000, 80), (1_000_000, 80), (1_000_000, 85)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, percent=percent, block=block).collect())
        assert got == brute(docs, percent)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e}
    find = lambda x: x if low[x] == x else find(low[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    assert got == {x: find(x) for x in low}


def test_links_inside_blocks():
    rng = np.random.default_rng(7)
    for percent in (50, 80, 85, 100):
        base = [np.unique(rng.integers(0, 400, rng.integers(1, 60))) for _ in range(12)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.1, rng.integers(0, 400, len(b)), b)).astype(np.uint64) for b in base for _ in range(6)]
        left, right = rng.random(len(sets)) < 0.7, rng.random(len(sets)) < 0.7
        low = list(range(len(sets)))
        find = lambda x: x if low[x] == x else find(low[x])
        for i in np.flatnonzero(left):
            for j in np.flatnonzero(right):
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])):
                    x, y = sorted((find(i), find(j)))
                    low[y] = x
        assert linked(sets, left, right, percent).tolist() == [find(x) for x in range(len(sets))]
