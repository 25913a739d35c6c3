"""Conversation repair against a plain search over all edits, in chunks of every size, and edge cases."""

import functools
import hashlib
import random
import zlib

import pytest
from fleetlens.llm import repair as module
from fleetlens.llm.queries import damaged
from fleetlens.llm.repair import END, repair, repaired, run_back, summary, text_digests

SPACES = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest())


def least(rows):
    """(cost, audit, lines) of the cheapest edits of (turn, role, text) rows, by trying all."""
    seen, marked = set(), []
    for _, role, text in sorted(rows, key=order):
        bare = text.strip(SPACES)
        marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))

    @functools.cache
    def best(i, last, room):
        """From row i on after an initial, with room for so many turns put in before the next row."""
        found = [(0, "", ())] if i == len(marked) and last in ("", "a") else []
        put = lambda cost, letter, line, rest: found.append((cost + rest[0], letter + rest[1], line + rest[2]))
        for c in FOLLOWS[last]:
            if room and c != "s":
                put(2, "I", ("user:" if c == "u" else "assistant:",), best(i, c, room - 1))
        if i < len(marked):
            role, text, fault = marked[i]
            put(3, "D", (), best(i + 1, last, 3))
            if fault in (None, "truncated"):
                for c in FOLLOWS[last]:
                    if c == role[:1]:
                        put(fault is not None, "K", (f"{role}:{text}",), best(i + 1, c, 3))
                    if c != "s":
                        put(2 + (fault is not None), "R", (f"{'user' if c == 'u' else 'assistant'}:{text}",), best(i + 1, c, 3))
        return min(found, default=(10**9, "", ()))

    for i in range(len(marked), 0, -1):  # from the end, so that no call nests deep
        for last in FOLLOWS:
            best(i, last, 3)
    return best(0, "", 3), [f for *_, f in marked], [r[:1] for r, *_ in marked]


def expected(rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append((row[0], row[1] or "", row[2] or ""))
    out = {}
    for conv, own in groups.items():
        (cost, audit, lines), faults, initials = least(own)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, edit int")
    edits = repair(frame, **settings).persist()
    assert edits.count() == len(rows)
    digests = {r.conv_id: r.repaired_sha256 for r in text_digests(repaired(edits)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, none)) for r in summary(edits).collect()}


def conversation(conv, n, roles, texts, turns):
    return [(conv, random.choice(turns), random.choice(roles), random.choice(texts), "x", 1) for _ in range(n)]


@pytest.mark.parametrize("bits", [2, 12])
def test_against_all_edits(spark, bits):
    random.seed(bits)
    roles = ["user", "assistant", "system", "tool", "", None, "a", "u"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "é?\t ", "4.", "5.", "6.", "7.", "8.", "\xa0."]
    rows = []
    for conv in range(60):
        rows += conversation(conv, random.randrange(1, 14), random.choice([roles, roles[:3], roles[:2]]), random.choice([texts, texts[7:12]]), [None, 0, 1, 2, 3, 5, 9])
    rows += conversation(None, 9, roles, texts, [1, 2, 3])
    got = found(spark, rows, chunk_bits=bits)
    assert got == expected(rows)


def test_runs_that_do_not_converge(spark):
    """Turns of one role, and rows that all repeat each other, carry differences of cost over any distance."""
    rows = [(1, i, "user", f"{i}.", "x", 1) for i in range(301)] + [(2, i, "assistant", f"{i}.", "x", 1) for i in range(300)]
    rows += [(3, 0, "system", "One.", "x", 1)] + [(3, i, "user", "Same.", "x", 1) for i in range(1, 200)] + [(3, 200, "assistant", "End", "x", 1)]
    rows += [(4, None, "user", "Same.", "x", 1)] * 150
    rows += [(5, i, ("user", "assistant")[i % 2], f"{i}.", "x", 1) for i in range(500)]
    assert found(spark, rows, chunk_bits=3) == expected(rows)


def test_passes_end_where_differences_agree():
    """A run from another vector stops as soon as it differs from the earlier one by a constant."""
    codes, taken = [1, 2] * 500, []
    watch = lambda: (taken.append(c) or c for c in reversed(codes))
    other = tuple(x for x in module._steps.back(END, 1))
    assert other != END
    end = run_back(reversed(codes), END)
    assert run_back(watch(), other, END, end) == end == run_back(reversed(codes), other)
    assert len(taken) < 10


def test_very_long_text_and_empty_table(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long + ".", "x", 1), (1, 2, "user", long, "x", 1)]
    assert found(spark, rows) == expected(rows)
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    edits = repair(frame)
    assert edits.count() == 0 and summary(edits).count() == 0 and text_digests(repaired(edits)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (1, 2, None) for t in [*range(40), None]]
    got = sorted(str(tuple(r)) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, {1: "", 2: "A b c"}.get(k, text))
        want += [str(row)] * {0: 0, 3: 2}.get(k, 1)
    assert got == sorted(want)
