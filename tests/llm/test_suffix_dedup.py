"""Repeated byte strings against brute force, and the suffix sort itself."""

import random
from collections import Counter

import numpy as np
import pytest
from fleetlens.llm.suffix_dedup import Suffixes, _runs, anchors, remove_repeated_bytes, spans


def brute(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcé ", k=n))
    shared = [text(n) for n in (90, 110, 150, 400, 900)]
    docs = [(0, None), (1, ""), (2, text(50)), (3, "ab" * 400), (4, shared[4]), (4, shared[4]), (5, "x" * 130)]
    for i in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            s = list(s[a : rng.randint(a, len(s))])
            if s and rng.random() < 0.5:
                s[rng.randrange(len(s))] = "Z"
            parts += ["".join(s), text(rng.randint(0, 80))]
        docs.append((100 + i, "".join(parts)))
    return docs


@pytest.mark.parametrize("options", [{}, {"most_contexts": 3}, {"batch": 5, "bits": 12}, {"shorter": 70}, {"shorter": 70, "most_contexts": 2, "batch": 4}])
def test_against_brute_force(spark, options):
    docs = corpus(6)
    df = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, start long, c string")
    rows = remove_repeated_bytes(df, length=100, **options).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    assert got == brute(docs, 100)
    if "shorter" in options:
        assert sorted((r.doc_id, r.n_repeated) for r in rows) == sorted((d, n) for d, _, n, _, _ in brute(docs, 70))


def test_a_passage_in_many_texts(spark):
    """One passage with different words around it, far more often than a group may hold contexts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(40))
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(3, 30))), passage, *(word() for _ in range(rng.randint(3, 30)))])) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for options in ({"most_contexts": 20}, {"most_contexts": 20, "shorter": 64}):
        rows = remove_repeated_bytes(df, length=120, **options).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == brute(docs, 120)


def test_a_text_beyond_one_segment(spark):
    rng = np.random.default_rng(2)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    a, b, c = text(700), text(700), text(400)
    at = 1 << 21  # where one piece of a text ends and the next begins
    long = text(at - 300) + a + text(3 << 20) + b
    docs = [(1, long), (2, "x" + a + "y"), (3, c + b), (4, text(5000) + c + text(10))]
    rows = remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(1, len(long), 1400, 2), (2, 702, 700, 1), (3, 1100, 1100, 1), (4, 5410, 400, 1)]


def test_passages_of_over_fifty_words(spark):
    """Passages of 51 to 80 words that two texts share: which reach 400 bytes, and that those and all of 240 are found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.choice((2, 3, 4, 5, 6, 7, 9))))
    words = lambda n: [word() for _ in range(n)]
    docs, size = [], {}
    for i in range(60):
        passage = words(51 + i // 2)
        for k in (0, 1):
            docs.append((2 * i + k, " ".join([*words(rng.randint(60, 200)), *passage, *words(rng.randint(60, 200))])))
            size[2 * i + k] = len(" ".join(passage)) + 2
    docs += [(1000 + i, " ".join(words(200))) for i in range(40)]
    rows = {r.doc_id: r for r in remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"), shorter=240).collect()}
    whole = [d for d, n in size.items() if n >= 402]
    assert 0 < len(whole) < len(size) and min(size.values()) > 240
    assert all(rows[d].n_removed >= 400 for d in whole)
    assert all(rows[d].n_repeated >= size[d] - 2 for d in size) and all(rows[1000 + i].n_repeated == 0 for i in range(40))
    print(f"{len(whole)} of {len(size)} passages reach 400 bytes")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(3)
    size = rng.integers(0, 30, 500)
    text = rng.integers(97, 99, (500, 30)).astype(np.uint8)
    text[np.arange(30) >= size[:, None]] = 0
    group = np.sort(rng.integers(0, 9, 500))
    s = Suffixes(text, size, group)
    order = s.sort()
    want = sorted(range(500), key=lambda i: (group[i], bytes(text[i, : size[i]])))
    key = lambda i: (group[i], bytes(text[i, : size[i]]))
    assert [key(i) for i in order] == [key(i) for i in want]
    gaps = s.neighbours(order)
    for a, b, g in zip(order[:-1], order[1:], gaps[1:], strict=True):
        x, y = key(a)[1], key(b)[1]
        n = next((j for j, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        assert g == (n if group[a] == group[b] else -1)


def test_every_window_has_its_anchor():
    data = np.random.default_rng(1).integers(0, 4, 1000).astype(np.uint8)
    place, _, first, last = anchors(data, 60)
    assert first[0] == 0 and last[-1] == 940 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 60 - 32)).all()


def test_anchors_of_texts_taken_together():
    """Texts that are joined have the anchors that each has alone, short ones and those of several segments alike."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 4, n).astype(np.uint8) for n in (60, 300, 61, 70_000, 59, 2000, 100)]
    start = np.cumsum([0, *(len(t) for t in texts)])
    got = anchors(np.concatenate(texts), 60, start[1:])
    alone = [anchors(t, 60) for t in texts]
    for k, x in enumerate(got):
        assert (x == np.concatenate([a[k] + (0 if k == 1 else s) for a, s in zip(alone, start, strict=False)])).all()


def test_sort_compares_within_groups():
    """Rows of many groups of two are each compared once with the other one, however many groups there are."""
    rng = np.random.default_rng(5)
    compared = 0

    class Counted(Suffixes):
        def less(self, a, b):
            nonlocal compared
            compared += len(a)
            return super().less(a, b)

    n = 4000
    Counted(rng.integers(97, 99, (n, 12)).astype(np.uint8), np.full(n, 12), np.arange(n) // 2).sort()
    assert compared <= 2 * n


def test_runs_and_spans():
    rng = np.random.default_rng(6)
    size = rng.integers(0, 80, 50)
    row = rng.integers(0, 50, 120)
    row = row[size[row] > 1]
    start = rng.integers(0, size[row])
    end = rng.integers(start + 1, size[row] + 1)
    covered = [np.zeros(n, bool) for n in size]
    for r, s, e in zip(row, start, end, strict=True):
        covered[r][s:e] = True
    edges = lambda flags: np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]]))).reshape(-1, 2).tolist()
    got = _runs(row, start, end, size)
    assert [list(x) for x in zip(*(y.tolist() for y in got), strict=True)] == [[r, *e] for r in range(50) for e in edges(covered[r])]
    flags = rng.random((40, 30)) < 0.6
    want = [(r, -7 - b + 1, 20 - 7 - a) for r in range(40) for a, b in edges(flags[r])]
    rows, cover = spans(flags, 7, 20)
    assert [(r, s, e) for r, (s, e) in zip(rows.tolist(), cover.tolist(), strict=True)] == want
