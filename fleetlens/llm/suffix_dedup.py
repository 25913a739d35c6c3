"""Repeated byte strings by a hash-compared suffix sort.

Every ``length``-byte window has an anchor: the place of its least k-gram hash, the first of equals. Equal windows have equal
anchors at equal offsets, so it is enough to compare the text around anchors of one k-gram. A sketch of all anchors first
drops those whose k-gram occurs once. The contexts of the others - the bytes of all windows of an anchor - are made distinct in
their partition (by a 128-bit digest) and grouped by k-gram, and their suffixes at the anchor are sorted to the right and to the left:
prefix polynomial hashes and binary search give the common extension of two suffixes, so a comparison takes a logarithm of the
length; a mergesort places the elements of either run in the other by such comparisons. The common extensions of neighbours are
verified on the bytes themselves, which corrects any collision. Two contexts share the window that starts d bytes before the anchor
where their common extensions are at least d to the left and ``length`` - d to the right: those are intervals of the two orders.

A group of more than ``most_contexts`` is not gathered: its windows are dealt again in two halves, by their d. All windows of a half
have a longer core in common than the k-gram, which is the new key, and only what stands beside the core goes along, equal rows
merged before the shuffle. So a half is smaller unless its core is as common as the k-gram was; the last halves are single windows, of
which the count alone is the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored, take_turn
from .decontaminate import gram_hashes
from .substring import _spread, merge_blocks, pack_gaps

K = 32
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: Windows whose hashes are made at once: their arrays stay in a core's cache.
_SEGMENT = 1 << 15
#: Bytes of short texts that are taken together.
_TOGETHER = 1 << 20
_BASE = np.uint64(0xD1342543DE82EF95)
_CODE = _spread(np.arange(1, 257, dtype=np.uint64), *_MIX)


def anchors(data: np.ndarray, length: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the bytes: (anchor place, its k-gram's hash mixed anew, first window, last window), in order. The hash by
    which anchors are chosen is low for all of them; the new one is spread evenly. ``ends``: where the texts end that the bytes are
    made of, for windows that lie in one text."""
    out: list[tuple[np.ndarray, ...]] = []
    w = length - K + 1
    for begin in range(0, len(data) - length + 1, _SEGMENT):
        part = data[begin : begin + _SEGMENT + length - 1]
        h = _spread(gram_hashes(part.astype(np.uint64), K), *_MIX)
        n = len(h)
        key = (h & ~np.uint64((1 << 22) - 1)) | np.arange(n, dtype=np.uint64)
        pad = -(-n // w) * w
        full = np.full(pad, np.iinfo(np.uint64).max)
        full[:n] = key
        blocks = full.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - w + 1
        place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64((1 << 22) - 1)).astype(np.int64)
        at = None
        if ends is not None:
            inside = np.ones(windows, bool)
            for e in ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + windows + length - 1)].tolist():
                inside[max(0, e - begin - length + 1) : max(0, e - begin)] = False
            at = np.flatnonzero(inside)
            place = place[at]
        if not len(place):
            continue
        new = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.concatenate([[0], new]), np.append(new, len(place)) - 1
        place = place[first]
        if at is not None:
            first, last = at[first], at[last]
        out.append((place + begin, _spread(h[place], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), first + begin, last + begin))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    place, h, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.concatenate([[True], place[1:] != place[:-1]])  # the windows of one anchor may lie in two segments
    return place[new], h[new], first[new], last[np.append(new[1:], True)]


def text_anchors(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(rows, bytes, where each row's text ends in them, anchors) of texts (r, text) that are taken together; a text without a window is left out."""
    for b in batches:
        raw = b.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False)
        size = np.array([len(x) for x in raw], np.int64)
        at = np.flatnonzero(size >= length)
        row = b.column(0).to_numpy()[at]
        lot = np.cumsum(size[at]) // _TOGETHER
        edge = np.concatenate([[0], np.flatnonzero(np.diff(lot)) + 1, [len(at)]]) if len(at) else [0]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            data, ends = b"".join(raw[at[i:j]]), np.cumsum(size[at[i:j]])
            yield row[i:j], data, ends, anchors(np.frombuffer(data, np.uint8), length, ends)


class Suffixes:
    """Rows of bytes, each a suffix of ``size`` valid bytes, in groups: sorts them with hash-compared extensions."""

    def __init__(self, text: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.text, self.size, self.group = text, size.astype(np.int64), group
        n, self.width = text.shape
        # prefix[i, j]: the polynomial hash of the first j bytes, times the base to the power of the rest
        power = np.cumprod(np.full(self.width + 1, _BASE, np.uint64))
        self.prefix = np.zeros((n, self.width + 1), np.uint64)
        for i in range(0, n, 1024):
            np.cumsum(_CODE[text[i : i + 1024]] * power[1:], axis=1, out=self.prefix[i : i + 1024, 1:])
        self.flat = self.prefix.ravel()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, by binary search over equal prefix hashes; the whole is tried first."""
        out = np.minimum(self.size[a], self.size[b])
        at, bt = a * (self.width + 1), b * (self.width + 1)
        go = np.flatnonzero(self.flat[at + out] != self.flat[bt + out])
        at, bt, low, high = at[go], bt[go], np.zeros(len(go), np.int64), out[go] - 1
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.flat[at + mid] == self.flat[bt + mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[go] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a before b: by group, then by the first byte after the common extension; a prefix before what it begins."""
        out = self.group[a] < self.group[b]
        tie = np.flatnonzero(self.group[a] == self.group[b])
        x, y = a[tie], b[tie]
        n = self.common(x, y)
        end_x, end_y = n >= self.size[x], n >= self.size[y]
        at = np.minimum(n, self.width - 1)
        out[tie] = np.where(end_x | end_y, end_x & ~end_y, self.text[x, at] < self.text[y, at])
        return out

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort of all rows, whose groups are in order; every level merges all its pairs of runs at once. A row's place in
        the other run lies among its group there."""
        n = len(self.size)
        order = np.arange(n)
        begin, end = np.searchsorted(self.group, self.group), np.searchsorted(self.group, self.group, "right")
        run = 1
        while run < n:
            i = np.arange(n)
            pair, left = i // (2 * run), i // run % 2 == 0
            start = pair * 2 * run
            other_lo = np.where(left, np.minimum(start + run, n), start)
            other_hi = np.where(left, np.minimum(start + 2 * run, n), np.minimum(start + run, n))
            low, high = np.clip(begin, other_lo, other_hi), np.clip(end, other_lo, other_hi)
            while True:
                go = np.flatnonzero(low < high)
                if not len(go):
                    break
                mid = (low[go] + high[go]) >> 1
                mine, other = order[go], order[mid]
                # an element of the left run goes before its equals of the right one
                before = np.where(left[go], self.less(other, mine), ~self.less(mine, other))
                low[go] = np.where(before, mid + 1, low[go])
                high[go] = np.where(before, high[go], mid)
            own = i - np.where(left, start, np.minimum(start + run, n))
            new = np.empty(n, np.int64)
            new[start + own + low - other_lo] = order
            order = new
            run *= 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each row in the order with the one before it; -1 at a group's start. Verified on the bytes."""
        out = np.full(len(order), -1, np.int64)
        a, b = order[:-1], order[1:]
        tie = np.flatnonzero(self.group[a] == self.group[b])
        for s in range(0, len(tie), 4096):
            t = tie[s : s + 4096]
            x, y = a[t], b[t]
            differ = self.text[x] != self.text[y]
            real = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
            out[t + 1] = np.minimum(real, np.minimum(self.size[x], self.size[y]))
        return out


def repeated(left: list[bytes], right: list[bytes], lo: int, hi: int, base: list[int], first: np.ndarray, last: np.ndarray, count: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each of ``base`` (n, hi - lo + 1) flags: the window that starts d bytes before the anchor, lo <= d <= hi, also starts elsewhere.

    ``left``: what stands before the core, in order of the text; ``right``: what stands after it. The window d takes d - lo bytes of
    the left and hi - d + base of the right. ``first`` and ``last``: the d that a row has; ``count``: times that it occurs;
    ``group``: non-decreasing numbers of the cores.
    """
    n, most = len(left), hi - lo

    def ordered(parts: list[bytes], width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the strings, read backwards for a step of -1, and their neighbours' common extensions."""
        size = np.array([len(c) for c in parts], np.int64)
        flat, end = np.frombuffer(b"".join(parts) or b"\0", np.uint8), np.cumsum(size)
        start = end - size if step > 0 else end - 1
        valid, text, column = np.minimum(size, width), np.zeros((n, max(width, 1)), np.uint8), np.arange(max(width, 1))
        for i in range(0, n, 1024):
            part = slice(i, i + 1024)
            take = np.clip(start[part, None] + step * column, 0, len(flat) - 1)
            text[part] = np.where(column < valid[part, None], flat[take], 0)
        s = Suffixes(text, valid, group)
        order = s.sort()
        return order, s.neighbours(order)

    order_r, gap_r = ordered(right, most + max(base), 1)
    order_l, gap_l = ordered(left, most, -1)
    reach = np.array([len(c) for c in right], np.int64)
    first, last = np.maximum(first, lo), np.minimum(last, hi)

    def nearest(order: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """What each row has in common with the nearer of its neighbours in the order."""
        out = np.empty(n, np.int64)
        out[order] = np.maximum(gap, np.append(gap[1:], -1))
        return out

    most_l, most_r = nearest(order_l, gap_l), nearest(order_r, gap_r)
    own_r, own_l = np.empty(n, np.int64), np.empty(n, np.int64)
    bits = np.int64(n.bit_length())
    out = []
    for more in base:
        flags = np.zeros((n, most + 1), bool)
        # a row that occurs twice has all its windows twice; any other shares them as far as with a neighbour in either order
        begin = np.maximum(first, hi + more - reach)
        for i in np.flatnonzero((count > 1) & (begin <= last)).tolist():
            flags[i, begin[i] - lo : last[i] - lo + 1] = True
        begin, end = np.maximum(begin, hi + more - most_r), np.minimum(last, lo + most_l)
        rows = np.flatnonzero(begin <= end)
        begin, end = begin[rows], end[rows]
        for d in range(lo, hi + 1):
            has = rows[(d >= begin) & (d <= end)]
            if len(has) < 2:
                continue
            own_r[order_r] = np.cumsum(gap_r < hi - d + more)
            own_l[order_l] = np.cumsum(gap_l < d - lo)
            key = np.sort((own_r[has] * (n + 1) + own_l[has]) << bits | has)
            same = np.flatnonzero(key[1:] >> bits == key[:-1] >> bits)
            flags[key[same] & ((1 << bits) - 1), d - lo] = True
            flags[key[same + 1] & ((1 << bits) - 1), d - lo] = True
        out.append(flags)
    return out


def spans(flags: np.ndarray, lo: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, interval): byte intervals (start, end), from the anchor on, that each row's flagged windows cover, merged."""
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    return row, np.stack([-lo - b, length - lo - a], axis=1)


def _sketch(rows: DataFrame, length: int, bits: int) -> bytes:
    """The bits of the anchor cells that are counted twice or more."""
    block_bits = min(bits, 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bytes")
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            cells, times = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            cells = cells.astype(np.int64)
            edge = np.searchsorted(cells >> block_bits, np.arange((1 << (bits - block_bits)) + 1))
            own = [b for b in range(1 << (bits - block_bits)) if edge[b + 1] > edge[b]]
            part = lambda b: cells[edge[b] : edge[b + 1]] - (b << block_bits)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([pack_gaps(part(b)) for b in own], pa.binary()), pa.array([pack_gaps(part(b)[times[edge[b] : edge[b + 1]] > 1]) for b in own], pa.binary())], names=["k", "once", "more"])

        for *_, (_, h, _, _) in text_anchors(batches, length):
            held.append(h)
            n += len(h)
            if n > 2_000_000:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    out = bytearray((1 << bits) // 8)
    counted = rows.mapInArrow(count, "k int, once binary, more binary")
    for r in counted.repartition("k").sortWithinPartitions("k").mapInArrow(merge_blocks(block_bits), "k int, bits binary").collect():
        at = r.k << block_bits >> 3
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


#: The sketch is 128 MB of bits at most.
_MAX_BITS = 30


def repeated_spans(rows: DataFrame, lengths: tuple[int, ...] = (400,), bits: int | None = None, batch: int = 2500, most_contexts: int = 20_000) -> DataFrame:
    """(kind, r, start, end): byte intervals of the rows (r long, text string) that windows of lengths[kind] bytes cover which start
    elsewhere too; the intervals of a row may touch or overlap. The least length comes first. ``bits``: the sketch has 2 ** bits
    cells, by default eight or more for each anchor, at most 2 ** 30; a fuller one lets more through and loses nothing."""
    spark = rows.sparkSession
    least = lengths[0]
    top = least - K
    if bits is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        bits = min(_MAX_BITS, max(12, math.ceil(math.log2(16 * size / (top + 2) + 2))))
    shared = spark.sparkContext.broadcast(_sketch(rows, least, bits))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Lists of all anchors that may repeat: (row, anchor in its text, digest, k-gram, bytes, window bytes from and to, anchor in the bytes, windows)."""
        take_turn("bytes")
        seen_bits = np.frombuffer(shared.value, np.uint8)
        for row, raw, ends, (place, h, first, last) in text_anchors(batches, least):
            cell = h >> np.uint64(64 - bits)
            at = np.flatnonzero(seen_bits[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & 1)
            place, first, last = place[at], first[at], last[at]
            doc = np.searchsorted(ends, place, "right")
            begin, end = first.tolist(), np.minimum(last + lengths[-1], ends[doc]).tolist()
            digests = [xxhash.xxh3_128_digest(raw[i:e], seed=s) for i, e, s in zip(begin, end, (place - first << 12 | last - first).tolist(), strict=True)]
            grams = h[at].astype(">u8").tobytes()
            yield row[doc], place - np.append(0, ends)[doc], digests, [grams[i : i + 8] for i in range(0, len(grams), 8)], raw, begin, end, place.tolist(), (last - first + 1).tolist()

    columns = {"g": pa.binary(), "kind": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "c": pa.binary(), "left": pa.binary(), "right": pa.binary(), "first": pa.int32(), "last": pa.int32(), "n": pa.int32()}
    schema = "g binary, kind int, lo int, hi int, c binary, left binary, right binary, first int, last int, n int"

    class Merged:
        """Rows by key and digest, made distinct while they are few enough to be held."""

        def __init__(self) -> None:
            self.rows: dict[tuple, list] = {}
            self.held = 0

        def add(self, g: bytes, kind: int, lo: int, hi: int, c: bytes, left: bytes, right: bytes, first: int, last: int, n: int) -> bool:
            known = self.rows.get((g, c))
            if known is not None:
                known[-1] = 2
                return False
            self.rows[g, c] = [g, kind, lo, hi, c, left, right, first, last, n]
            self.held += len(left) + len(right) + 500  # and the objects that hold it
            return self.held > 24 << 20

        def flush(self) -> pa.RecordBatch:
            values = list(self.rows.values())
            self.rows, self.held = {}, 0
            return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(columns.values())], names=list(columns))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Merged()
        for _, _, digests, grams, raw, begin, ends, place, windows in found(batches):
            for c, g, i, end, p, n in zip(digests, grams, begin, ends, place, windows, strict=True):
                if (g, c) in known.rows:
                    known.rows[g, c][-1] = 2
                elif known.add(g, -1, 0, top, c, raw[i:p], raw[p:end], p - i - n + 1, p - i, 1):
                    yield known.flush()
        if known.rows:
            yield known.flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, p, digests, *_ in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(p, pa.int64()), pa.array(digests, pa.binary())], names=["r", "i", "c"])

    def bases(kind: int) -> list[int]:
        """How much more of the right part than hi - d a window takes: at the k-gram for each length, later for one."""
        return [K + x - least for x in lengths] if kind < 0 else [0]

    def answer(c: bytes, kind: int, intervals: np.ndarray, out: list[list]) -> None:
        out[0] += [c] * len(intervals)
        out[1] += [kind] * len(intervals)
        out[2] += intervals[:, 0].tolist()
        out[3] += intervals[:, 1].tolist()

    def settle(parts: list[list], out: list[list]) -> None:
        """Adds the answers of whole groups of one range of d."""
        if parts[0][1] < 0:  # rows of two digests differ
            own = [[row, row[9], [row[4]]] for row in parts]
        else:
            merged: dict[tuple, list] = {}
            for row in parts:
                key = row[0], row[5], row[6], row[7], row[8]
                if key in merged:
                    merged[key][1] += row[9]
                    merged[key][2].append(row[4])
                else:
                    merged[key] = [row, row[9], [row[4]]]
            own = list(merged.values())
        kind, lo, hi = own[0][0][1:4]
        _, group = np.unique([x[0][0] for x in own], return_inverse=True)
        order = np.argsort(group, kind="stable")
        alone = np.bincount(group)[group] == 1
        whole, sort = [i for i in order if alone[i] and own[i][1] > 1], [i for i in order if not alone[i]]
        base, kinds = bases(kind), range(len(lengths)) if kind < 0 else [kind]
        for i in whole:
            row = own[i][0]
            for k, more in zip(kinds, base, strict=True):
                d = np.arange(max(row[7], lo, hi + more - len(row[6])), min(row[8], hi) + 1)
                if len(d):
                    for c in own[i][2]:
                        answer(c, k, np.array([[-d[-1], lengths[k] - d[0]]]), out)
        if sort:
            rows = [own[i][0] for i in sort]
            numbers = lambda j: np.array([r[j] for r in rows], np.int64)
            flags = repeated([r[5] for r in rows], [r[6] for r in rows], lo, hi, base, numbers(7), numbers(8), np.array([own[i][1] for i in sort], np.int64), group[sort])
            for k, found_ in zip(kinds, flags, strict=True):
                row, cover = spans(found_, lo, lengths[k])
                for j, s, e in zip(row.tolist(), *cover.T.tolist(), strict=True):
                    digests = own[sort[j]][2]
                    for x, more in zip(out, (digests, [k] * len(digests), [s] * len(digests), [e] * len(digests)), strict=True):
                        x += more

    def single(row: list, out: list[list]) -> None:
        """A window of several contexts: each of them holds it."""
        answer(row[4], row[1], np.array([[-row[2], lengths[row[1]] - row[2]]]), out)

    def halves(row: list) -> Iterator[tuple]:
        """The row in the two halves of its range of d, for each length, with a longer core as key."""
        g, kind, lo, hi, c, left, right, first, last, n = row
        m = (lo + hi) // 2
        for k, more in zip(range(len(lengths)) if kind < 0 else [kind], bases(kind), strict=True):
            for a, b in ((lo, m), (m + 1, hi)):
                inner, ahead = a - lo, hi - b + more
                if a > b or first > b or last < a or len(right) < ahead or len(left) < inner:
                    continue
                core = left[len(left) - inner :] + right[:ahead]
                key = xxhash.xxh3_128_digest(g + bytes([k]) + a.to_bytes(4) + b.to_bytes(4) + core)
                rest = left[: len(left) - inner]
                yield key, k, a, b, c, rest[max(0, len(rest) - (b - a)) :], right[ahead : ahead + b - a], max(first, a), min(last, b), n

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers (c, kind, s, e) of the groups that are small enough, and rows in halves of the others."""
        take_turn("bytes")
        out: list[list] = [[], [], [], []]
        held: list[list] = []  # whole groups of one range of d
        group: dict[bytes, list] = {}
        now, large = None, False
        more = Merged()

        def answers() -> pa.RecordBatch:
            n = len(out[0])
            parts = [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if name not in ("kind", "c") else parts[1] if name == "kind" else parts[0] for name, t in columns.items()] + parts[2:], names=[*columns, "s", "e"])

        def rest() -> pa.RecordBatch:
            b = more.flush()
            return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.int32())], names=[*columns, "s", "e"])

        def finish() -> None:
            if len(group) > 1 or any(row[9] > 1 for row in group.values()):  # a context that is alone shares no window
                held.extend(group.values())
            group.clear()

        def settle_held() -> None:
            if held:
                settle(held, out)
                held.clear()

        for b in batches:
            for row in map(list, zip(*(b.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(len(columns))), strict=True)):
                if row[:4] != now:
                    finish()
                    if len(held) >= batch or now is not None and row[1:4] != now[1:4]:
                        settle_held()
                    now, large = row[:4], False
                known = group.get(row[4])
                if large:
                    if row[1] >= 0 and row[2] == row[3]:
                        single(row, out)
                    else:
                        for half in halves(row):
                            if more.add(*half):
                                yield rest()
                elif known is not None:
                    known[9] += row[9]
                else:
                    group[row[4]] = row
                    leaf = row[1] >= 0 and row[2] == row[3]
                    if len(group) > (1 if leaf else most_contexts):
                        large = True
                        for r in group.values():
                            if leaf:
                                single(r, out)
                            else:
                                for half in halves(r):
                                    if more.add(*half):
                                        yield rest()
                        group.clear()
                if len(out[0]) >= 20_000:
                    yield answers()
        finish()
        settle_held()
        if out[0]:
            yield answers()
        if more.rows:
            yield rest()

    answers = None
    now = rows.mapInArrow(contexts, schema)
    while True:  # once where no group is large; each further round halves the ranges of d
        dealt = now.repartition("kind", "lo", "hi", "g").sortWithinPartitions("kind", "lo", "hi", "g")
        got = stored(dealt.mapInArrow(sort, f"{schema}, s int, e int"), "answers")
        mine = got.filter("s is not null").select("c", "kind", "s", "e")
        answers = mine if answers is None else answers.unionByName(mine)
        now = got.filter("s is null").select(*columns)
        if now.isEmpty():
            break
    where = rows.mapInArrow(places, "r long, i long, c binary")
    return where.join(answers, "c").select("kind", "r", (F.col("i") + F.col("s")).alias("start"), (F.col("i") + F.col("e")).alias("end"))


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the maximal runs that the rows' intervals cover, in order; ``size``: the bytes of each row."""
    if not len(row):
        return row, start, end
    base = np.cumsum(size + 1) - size  # the rows one after another, a byte apart
    order = np.argsort(base[row] + start)
    row, start, end = row[order], (base[row] + start)[order], np.maximum.accumulate((base[row] + end)[order])
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    first, last = np.concatenate([[0], new]), np.append(new, len(start)) - 1
    row = row[first]
    return row, start[first] - base[row], end[last] - base[row]


def remove_repeated_bytes(docs: DataFrame, length: int = 400, stable: bool = False, as_text: bool = False, shorter: int | None = None, **options) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the bytes that stay) added;
    ``as_text``: kept is a string, without the bytes of characters that a cut went through. ``shorter``: a lesser length, for which
    n_repeated is added, the bytes that strings of that length cover which start elsewhere too; they are counted and not removed.

    Removes each byte of the UTF-8 text that a ``length``-byte string covers which also starts anywhere else, in the same
    document or another; strings never cross documents and are judged on the input. Null and empty texts have no bytes.
    Repeated rows are documents of their own, so rows with equal long texts lose all of it. Columns of the added names
    are replaced. ``stable``: as for substring.remove_repeats.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "n_repeated", "_row").withColumn("_row", F.monotonically_increasing_id())
    if not stable:
        plain = stored(plain, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    lengths = (length,) if shorter is None else (shorter, length)
    found = repeated_spans(plain.select(F.col("_row").alias("r"), text.alias("text")), lengths, **options)
    by_row = found.groupBy(F.col("r").alias("_row")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("_spans"))
    joined = plain.join(by_row, "_row", "left")
    at_text, at_spans = joined.columns.index("text"), joined.columns.index("_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(at_text).cast(pa.binary()).to_numpy(zero_copy_only=False)]
            size = np.array([len(x) for x in raw], np.int64)
            found = b.column(at_spans)
            row = np.repeat(np.arange(len(raw)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            kind, start, end = (x.to_numpy().astype(np.int64) for x in found.flatten().flatten())

            def runs(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                own = kind == k  # noqa: B023
                return _runs(row[own], start[own], end[own], size)  # noqa: B023

            def covered(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
                return np.bincount(row, end - start, len(raw)).astype(np.int64)  # noqa: B023

            gone = runs(len(lengths) - 1)
            parts: dict[int, list[bytes]] = {}
            past: dict[int, int] = {}
            for i, s, e in zip(*(x.tolist() for x in gone), strict=True):
                parts.setdefault(i, []).append(raw[i][past.get(i, 0) : s])
                past[i] = e
            kept = list(raw)
            for i, own in parts.items():
                kept[i] = b"".join([*own, raw[i][past[i] :]])
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            added = [pa.array(size), pa.array(covered(*gone)), pa.array(np.bincount(gone[0], minlength=len(raw)), pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
            if shorter is not None:
                added.append(pa.array(covered(*runs(0))))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "n_bytes", "n_removed", "n_spans", "kept", *more])

    more = [] if shorter is None else ["n_repeated"]
    fields = [*joined.schema.fields, *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(x, T.LongType()) for x in more)]
    return joined.mapInArrow(cut, T.StructType(fields)).drop("_row", "_spans")
