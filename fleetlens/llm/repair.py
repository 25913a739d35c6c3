"""Repair of conversations to ``(s?(ua)+)?`` by least edits, solved in chunks whose cost vectors converge in rank.

A row is kept (0), given the role user or assistant (2) or deleted (3); an empty turn of either role may be put in anywhere (2). Blank
and repeated rows must go; a row cut short costs 1 more if it stays. Over the four states of the pattern (nothing yet, after s, after u,
after a) a row is a min-plus step, so the costs to the end form a vector of four numbers of which only the differences matter.

Rows are ordered by one range sort and numbered, and 4096 numbers make a chunk, so a conversation of any length spreads over chunks and
tasks. Every chunk runs backwards from a speculative vector, that of a conversation's end. A fix-up pass stitches the chunks of a
conversation and runs those again whose true vector differs from what they assumed by more than a constant, in step with their
earlier run until both differ by a constant only. All results of a chunk are kept by the vector that it began with; such vectors are few, so
few passes suffice even where nothing converges, as in a run of turns of one role. With the stitched backward costs each chunk is
traced forwards for every state that it may begin in, the states are stitched, and the edits are read off: at each step the least
letter of D, I, K and R that stays on a cheapest way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, take_turn

CHUNK_BITS = 12
_SPACES = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state after a turn of user or assistant, whichever may follow.
_OTHER = (2, 2, 3, 2)
#: By initial (0 s, 1 u, 2 a, 3 another): the state that a kept row leads to.
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_FAULTS = (None, "blank", "duplicate", "truncated")
Vector = tuple[int, ...]


def with_inserts(costs: list[int]) -> list[int]:
    """Costs by state where turns may be put in first."""
    u, a = min(costs[2], 2 + costs[3]), min(costs[3], 2 + costs[2])
    return [min(costs[0], 2 + u), min(costs[1], 2 + u), u, a]


#: The costs of a conversation's end: only states 0 and 3 may end one.
END: Vector = tuple(with_inserts([0, 99, 99, 0]))


def _choices(after: Vector, code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost with what follows, next state) of what may be done with a row; code: the initial and four times the fault."""
    initial, fault = code & 3, code >> 2
    found = [("D", 3 + after[state], state)]
    if fault in (0, 3):
        cut = int(fault == 3)
        if state in _KEPT[initial]:
            found.append(("K", cut + after[_KEPT[initial][state]], _KEPT[initial][state]))
        found.append(("R", 2 + cut + after[_OTHER[state]], _OTHER[state]))
    return found


def _costs(after: Vector, code: int) -> list[int]:
    return with_inserts([min(c for _, c, _ in _choices(after, code, q)) for q in range(4)])


class _Steps:
    """Steps by vector and row, remembered: vectors without their common constant are few."""

    def __init__(self) -> None:
        self.backward: dict[tuple[Vector, int], Vector] = {}
        self.forward: dict[tuple[Vector, int, int], tuple[str, str, str, int]] = {}

    def back(self, after: Vector, code: int) -> Vector:
        found = self.backward.get((after, code))
        if found is None:
            costs = _costs(after, code)
            found = self.backward[after, code] = tuple(c - min(costs) for c in costs)
        return found

    def trace(self, after: Vector, code: int, state: int) -> tuple[str, str, str, int]:
        """(turns put in before the row, edit, new role, next state) of the least letters on a cheapest way."""
        found = self.forward.get((after, code, state))
        if found is None:
            costs, put, q = _costs(after, code), "", state
            while True:
                cheapest = [x for x in _choices(after, code, q) if x[1] == costs[q]]
                if 2 + costs[_OTHER[q]] == costs[q] and not any(x[0] == "D" for x in cheapest):
                    put, q = put + _letter(q), _OTHER[q]
                    continue
                edit, _, to = min(cheapest)
                break
            found = self.forward[after, code, state] = (put, edit, _letter(q) if edit == "R" else "", to)
        return found


def _letter(state: int) -> str:
    """The initial of the turn that leads on from a state."""
    return "a" if state == 2 else "u"


_steps = _Steps()


def _number(v: Vector) -> int:
    return sum(x << 8 * i for i, x in enumerate(v))


def _vector(n: int) -> Vector:
    return tuple(n >> 8 * i & 255 for i in range(4))


def _runs(convs: list) -> list[tuple[object, int, int]]:
    """(conversation, first row, row after the last) of the conversations in a chunk."""
    out, at = [], 0
    for conv, rows in groupby(convs):
        n = sum(1 for _ in rows)
        out.append((conv, at, at + n))
        at += n
    return out


def run_back(codes: Iterable[int], after: Vector, other: Vector | None = None, other_end: Vector | None = None) -> Vector:
    """The vector before rows, given in reverse order, from the one after them; ends early with ``other_end`` once a run from ``other`` in step
    with it has the same differences."""
    for code in codes:
        if after == other:
            return other_end
        after = _steps.back(after, code)
        other = _steps.back(other, code) if other is not None else None
    return after


def trace(codes: list[int], after: Vector, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """The edits of rows from ``state`` on, given the vector after the last, and the state that they lead to."""
    vectors = [after]
    for code in reversed(codes):
        vectors.append(_steps.back(vectors[-1], code))
    out = []
    for i, code in enumerate(codes):
        put, edit, role, state = _steps.trace(vectors[len(codes) - 1 - i], code, state)
        out.append((put, edit, role))
    return out, state


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows numbered (``seq``) in the order of conversations and turns; the number's lower 33 bits count the rows of a partition."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    own = rows.withColumns({"text": text, "role": role})
    own = own.withColumns({"_digest": F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256)), "_tie": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_digest"), F.col("_tie")]
    return own.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("seq", F.monotonically_increasing_id())


def _chunks(ordered: DataFrame, bits: int) -> DataFrame:
    """A row per chunk: its number, for each of its rows the conversation and the code, in order, and the places of rows that repeat none."""
    chunk = F.shiftright("seq", bits).alias("chunk")
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = F.when(end == "", 1).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3) + 4 * fault
    rows = ordered.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("seq", "conv_id", code.alias("code")))).alias("rows"))
    new = ordered.groupBy("conv_id", "_digest").agg(F.min("seq").alias("seq")).groupBy(chunk).agg(F.collect_list("seq").alias("new"))
    return rows.join(new, "chunk", "left").select("chunk", "rows.conv_id", "rows.code", F.transform(F.coalesce("new", F.array().cast("array<long>")), lambda s: s.bitwiseAND((1 << bits) - 1).cast("int")).alias("new"))


def _codes(codes: list[int], new: list[int]) -> list[int]:
    """Codes with the rows that repeat an earlier one of their conversation marked."""
    own = set(new)
    return [c if i in own or c >> 2 == 1 else c & 3 | 8 for i, c in enumerate(codes)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _edge_runs(convs: list) -> list[tuple[int, object, int, int]]:
    """(place, conversation, first, after the last) of the conversations that touch an end of a chunk and may go on beyond it."""
    runs = _runs(convs)
    return [(i, *runs[i]) for i in ([0, -1] if len(runs) > 1 else [0])]


def repair(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``rows`` (conv_id, turn, role, text and more), each with what becomes of it: seq, fault, illegal, put_before, edit, new_role, put_after.

    A conversation's rows are taken by turn, nulls first, equal turns by role and then by the SHA-256 of role and text; a null role or text is
    empty, a null conv_id a conversation of its own. ``fault`` is the first that holds of blank, duplicate (role and text seen earlier in
    the conversation, compared by that digest) and truncated (the last character that is no white space is none of ``.!?``), else null.
    ``illegal`` says that the row's and the previous row's initials are none of su, ua and au. ``edit`` is D, K or R (with ``new_role`` u
    or a); ``put_before`` and, after a conversation's last row, ``put_after`` hold the initials of turns put in. Of all cheapest edits these
    have the least letters. ``seq`` orders the rows; 2 ** ``chunk_bits`` of its numbers are solved as one. Columns of ``rows`` with the name of a result are replaced.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    own = ("seq", "fault", "illegal", "put_before", "edit", "new_role", "put_after", "_digest", "_tie")
    ordered = stored(_ordered(rows.drop(*own)), "turns")
    chunks = stored(_chunks(ordered, chunk_bits), "turn-chunks")
    conv = chunks.schema["conv_id"].dataType.elementType.simpleString()
    end = _number(END)

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("repair")
        for b in batches:
            out = []
            for chunk, convs, codes, new in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                codes = _codes(codes, new)
                out += [(c, chunk, place, end, _number(run_back(reversed(codes[x:y]), END))) for place, c, x, y in _edge_runs(convs)]
            yield _table(out, pa.schema([("conv_id", b.schema.field(1).type.value_type), *((n, pa.int64()) for n in ("chunk", "place", "given", "found"))]))

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("repair")
        for b in batches:
            out = []
            for chunk, convs, codes, new, place, given, old in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                c, x, y = _runs(convs)[place]
                found = run_back(reversed(_codes(codes, new)[x:y]), _vector(given), END, _vector(old))
                out.append((c, chunk, place, given, _number(found)))
            yield _table(out, pa.schema([("conv_id", b.schema.field(1).type.value_type), *((n, pa.int64()) for n in ("chunk", "place", "given", "found"))]))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each conversation's last chunk to its first: the vector that is due after a chunk, and those it is to be run from. A vector
        that one chunk lacks is asked of all before it as well, so each vector that occurs costs one pass at most."""
        now, due, asked = (), END, []
        for b in batches:
            out = []
            for c, chunk, place, known in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                last = now != (c,)
                if last:
                    now, due, asked = (c,), END, []
                runs = {k["given"]: k["found"] for k in known}
                if _number(due) not in runs and _number(due) not in asked:
                    asked.append(_number(due))
                out.append((c, chunk, place, _number(due), [v for v in asked if v not in runs], last, runs[end]))
                due = _vector(runs.get(_number(due), runs[end]))
            yield _table(out, pa.schema([("conv_id", b.schema.field(0).type), *((n, pa.int64()) for n in ("chunk", "place", "given")), ("missing", pa.list_(pa.int64())), ("last", pa.bool_()), ("old", pa.int64())]))

    known = stored(chunks.mapInArrow(speculate, f"conv_id {conv}, chunk long, place long, given long, found long"), "vectors")
    while True:
        runs = known.groupBy("conv_id", "chunk", "place").agg(F.collect_list(F.struct("given", "found")).alias("known"))
        line = runs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
        due = stored(line.mapInArrow(stitch, f"conv_id {conv}, chunk long, place long, given long, missing array<long>, last boolean, old long"), "due")
        missing = due.select("chunk", "place", F.explode("missing").alias("given"), "old")
        if missing.isEmpty():
            break
        known = known.unionByName(stored(chunks.join(missing, "chunk").select(*chunks.columns, "place", "given", "old").mapInArrow(fix, known.schema), "vectors"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("repair")
        for b in batches:
            out = []
            for chunk, convs, codes, new, place, given, last in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                c, x, y = _runs(convs)[place]
                own = _codes(codes, new)[x:y]
                out.append((c, chunk, place, given, last, [trace(own, _vector(given), q)[1] for q in range(4)], own[-1] & 3))
            yield _table(out, pa.schema([("conv_id", b.schema.field(1).type.value_type), *((n, pa.int64()) for n in ("chunk", "place", "given")), ("last", pa.bool_()), ("exits", pa.list_(pa.int32())), ("initial", pa.int32())]))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each conversation's first chunk to its last: the state that a chunk begins in, and the initial before it (-1: none)."""
        now, state, initial = (), 0, -1
        for b in batches:
            out = []
            for c, chunk, place, given, last, ways, final in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if now != (c,):
                    now, state, initial = (c,), 0, -1
                out.append((chunk, place, given, last, state, initial))
                state, initial = ways[state], final
            yield _table(out, pa.schema([*((n, pa.int64()) for n in ("chunk", "place", "given")), ("last", pa.bool_()), ("state", pa.int32()), ("initial", pa.int32())]))

    edges = chunks.join(due.select("chunk", "place", "given", "last"), "chunk").select(*chunks.columns, "place", "given", "last").mapInArrow(exits, f"conv_id {conv}, chunk long, place long, given long, last boolean, exits array<int>, initial int")
    entered = edges.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(enter, "chunk long, place long, given long, last boolean, state int, initial int")
    entered = entered.groupBy("chunk").agg(F.collect_list(F.struct("place", "given", "last", "state", "initial")).alias("edges"))  # two at most

    edit_schema = pa.schema([("seq", pa.int64()), ("fault", pa.string()), ("illegal", pa.bool_()), ("put_before", pa.string()), ("edit", pa.string()), ("new_role", pa.string()), ("put_after", pa.string())])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("repair")
        for b in batches:
            for chunk, convs, codes, new, ends in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                codes, runs, out = _codes(codes, new), _runs(convs), []
                at = {e["place"] % len(runs): e for e in ends}
                for i, (_, x, y) in enumerate(runs):
                    e = at.get(i, {"given": end, "last": True, "state": 0, "initial": -1})
                    found, state = trace(codes[x:y], _vector(e["given"]), e["state"])
                    before = e["initial"]
                    for k, (put, edit, role) in enumerate(found, x):
                        initial = codes[k] & 3
                        legal = before < 0 or (before, initial) in ((0, 1), (1, 2), (2, 1))
                        out.append(((chunk << chunk_bits) + k, _FAULTS[codes[k] >> 2], not legal, put, edit, role or None, ""))
                        before = initial
                    if e["last"]:
                        out[-1] = (*out[-1][:-1], {1: "ua", 2: "a"}.get(state, ""))
                yield _table(out, edit_schema)

    found = chunks.join(entered, "chunk").mapInArrow(edits, "seq long, fault string, illegal boolean, put_before string, edit string, new_role string, put_after string")
    return ordered.drop("_digest").join(found, "seq")


def repaired(edits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, seq and place (their order), role, text; turns put in are empty."""
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    made = lambda column: F.transform(F.filter(F.split(column, ""), lambda c: c != ""), lambda c: F.struct(name(c).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(name(F.col("new_role")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text"))))
    turns = F.concat(made("put_before"), own, made("put_after"))
    return edits.select("conv_id", "seq", F.posexplode(turns).alias("place", "_t")).select("conv_id", "seq", "place", "_t.role", "_t.text")


def summary(edits: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, rows by fault, illegal neighbours, cost and audit (the letters of its edits in order). Audits are put
    together by chunk first; counts are sums, so no task gathers a conversation."""
    inserts = F.char_length("put_before") + F.char_length("put_after")
    cost = F.when(F.col("edit") == "D", 3).otherwise(F.when(F.col("edit") == "R", 2).otherwise(0) + F.when(F.col("fault") == "truncated", 1).otherwise(0)) + 2 * inserts
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    faults = [count(F.col("fault") == f, f) for f in _FAULTS[1:]]
    sums = edits.groupBy("conv_id").agg(gaps, *faults, count(F.col("illegal"), "illegal"), F.sum(cost).cast("long").alias("cost"))
    letters = F.concat(F.repeat(F.lit("I"), F.char_length("put_before")), "edit", F.repeat(F.lit("I"), F.char_length("put_after")))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["letters"]), "")
    pieces = edits.groupBy("conv_id", F.shiftright("seq", CHUNK_BITS).alias("chunk")).agg(joined(F.collect_list(F.struct("seq", letters.alias("letters")))).alias("letters"))
    audits = pieces.groupBy("conv_id").agg(joined(F.collect_list(F.struct("chunk", "letters"))).alias("audit"))
    return sums.join(audits, sums["conv_id"].eqNullSafe(audits["conv_id"])).drop(audits["conv_id"])


def text_digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``repaired`` rows the SHA-256 of its ``role:text`` lines joined by newlines. A hash has an order, so a conversation's
    rows pass through one task, as a stream of which one row is held."""
    bounded_batches(turns.sparkSession)
    own = turns.select("conv_id", "seq", "place", F.concat_ws(":", "role", "text").alias("line"))
    conv = own.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("repair")
        now, h, schema = (), None, None
        for b in batches:
            schema, out = pa.schema([("conv_id", b.schema.field(0).type), ("repaired_sha256", pa.string())]), []
            for c, line in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                if now != (c,):
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = (c,), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.as_buffer())
            yield _table(out, schema)
        if now:
            yield _table([(*now, h.hexdigest())], schema)

    return own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place").mapInArrow(digest, f"conv_id {conv}, repaired_sha256 string")
