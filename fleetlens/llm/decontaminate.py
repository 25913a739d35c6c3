"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands, verified by banded alignment.

An item is cut into overlapping segments. Where a document holds a segment with at most k edits, its alignment stays
on k + 1 neighbouring diagonals and keeps at least m - q + 1 - q * k of the segment's q-grams. So shared q-grams are
counted in bands of 2 * (k + 1) diagonals that overlap by half, bands below that bound are dropped without loss, and the
rest is verified. Where a document holds no segment of an item, the same count over the q-grams of the whole item gives every
other place where a stretch of a segment's length can begin. The benchmark is small beside the corpus: its index is broadcast only below ``max_index_chars``, and
a larger one is gone through in parts, one pass over the documents each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, take_turn

_SPACE = re.compile(r"\s+")
_P = np.uint64(0x100000001B3)


def normal(text: str) -> str:
    """Lower case, white space as single spaces, trimmed."""
    return _SPACE.sub(" ", text.lower()).strip()


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q neighbouring code points, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    done, out, rest, power, width = 0, None, codes, _P, 1
    n = len(codes) - q + 1
    bit = q
    with np.errstate(over="ignore"):
        while bit:
            if bit & 1:
                part = rest[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += width
            bit >>= 1
            if bit:
                rest = rest[: len(rest) - width] * power + rest[width:]
                power = power * power
                width *= 2
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Index:
    """Segments of the items with their q-grams in hash order."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, segment: int):
        self.q, self.rate = q, rate
        self.item, self.text, self.offset = [], [], []
        self.whole: list[tuple[int, str]] = []  # items of several segments
        for item_id, raw in items:
            t = normal(raw)
            if not t:
                continue
            if len(t) > segment:
                self.whole.append((item_id, t))
            starts = [0] if len(t) <= segment else [*range(0, len(t) - segment, segment // 2), len(t) - segment]
            for s in starts:
                self.item.append(item_id)
                self.offset.append(s)
                self.text.append(t[s : s + segment])
        self.k = np.array([max(0, min(int(rate * len(t)), (len(t) - q) // q)) for t in self.text], np.int64)
        self.need = np.array([len(t) - q + 1 - q * k for t, k in zip(self.text, self.k, strict=True)], np.int64)
        self.short = [i for i, t in enumerate(self.text) if len(t) < q]
        grams = [gram_hashes(_codes(t), q) for t in self.text]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        seg = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], np.int64))
        pos = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.seg, self.pos = seg[order], pos[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.length = segment
        self.whole_k = max(0, min(int(rate * segment), (segment - q) // q))
        self.whole_need = segment - q + 1 - q * self.whole_k
        if segment < q:
            self.whole = []
        # the whole items' q-grams in the same hash order: each stands in a segment too
        grams = [gram_hashes(_codes(t), q) for _, t in self.whole]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        seg = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], np.int64))
        pos = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.whole_seg, self.whole_pos = seg[order], pos[order]
        self.whole_first = np.searchsorted(h[order], self.hash)
        self.whole_count = np.searchsorted(h[order], self.hash, "right") - self.whole_first
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's q-grams that stand in the index, and their numbers there."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        same = self.hash[i] == h[at]
        return at[same], i[same]

    def stretches(self, at: np.ndarray, i: np.ndarray, held: set[int]) -> list[tuple[int, int, np.ndarray]]:
        """(whole item, first diagonal of a band, starts in the item) of stretches of a segment's length with enough shared q-grams,
        for items not in ``held``."""
        if not self.whole or len(at) < self.whole_need:
            return []
        n = self.whole_count[i]
        flat = np.repeat(self.whole_first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        seg, pos = self.whole_seg[flat], self.whole_pos[flat]
        diagonal = np.repeat(at, n) - pos
        enough = np.bincount(seg, minlength=len(self.whole)) >= self.whole_need
        out, w, window = [], self.whole_k + 1, self.length - self.q + 1
        for item in np.flatnonzero(enough).tolist():
            if self.whole[item][0] in held:
                continue
            mine = seg == item
            p, band = pos[mine], diagonal[mine] // w
            p, band = np.concatenate([p, p]), np.concatenate([band, band - 1])
            order = np.argsort(band, kind="stable")
            p, band = p[order], band[order]
            value, first, count = np.unique(band, return_index=True, return_counts=True)
            for b, f, c in zip(value.tolist(), first.tolist(), count.tolist(), strict=True):
                if c >= self.whole_need:
                    run = np.concatenate([[0], np.cumsum(np.bincount(p[f : f + c], minlength=len(self.whole[item][1]) - self.q + 1))])
                    starts = np.flatnonzero(run[window:] - run[:-window] >= self.whole_need)
                    if len(starts):
                        out.append((item, b * w, starts))
        return out

    def candidates(self, at: np.ndarray, i: np.ndarray) -> list[tuple[int, int]]:
        """(segment, first diagonal of a band) with enough shared q-grams."""
        if len(at) < self.need[self.need > 0].min(initial=1 << 62):
            return []
        n = self.count[i]
        flat = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(i) else np.empty(0, np.int64)
        seg, diagonal = self.seg[flat], np.repeat(at, n) - self.pos[flat]
        enough = np.bincount(seg, minlength=len(self.text)) >= self.need  # a segment with too few in the whole text
        keep = enough[seg]
        seg, diagonal = seg[keep], diagonal[keep]
        if not len(seg):
            return []
        w = self.k[seg] + 1
        band = diagonal // w
        low = int(band.min()) - 1
        span = int(band.max()) - low + 1
        key, count = np.unique(np.concatenate([seg * span + band - low, seg * span + band - 1 - low]), return_counts=True)
        ok = count >= self.need[key // span]
        return [(int(s), int(b) * int(self.k[s] + 1)) for s, b in zip(key[ok] // span, key[ok] % span + low, strict=True)]


def align(segment: str, text: str, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most k) that turn ``segment`` into some stretch of ``text`` on the diagonals low - k to
    low + width + k: (edits, start, end), the first such end; else None."""
    lo, hi = max(0, low - k), min(len(text), low + width + len(segment) + k)
    part = text[lo:hi]
    at = part.find(segment)
    if at >= 0:
        return 0, lo + at, lo + at + len(segment)
    if k == 0:
        return None
    far = k + 1
    band_lo, band_hi = low - k - lo, low + width + k - lo  # diagonals (column - row) that are filled
    cost = {j: (0, j) for j in range(max(0, band_lo), min(len(part), band_hi) + 1)}
    for i, c in enumerate(segment, 1):
        row: dict[int, tuple[int, int]] = {}
        for j in range(max(0, band_lo + i), min(len(part), band_hi + i) + 1):
            best = (far, 0)
            if j and j - 1 in cost:
                e, s = cost[j - 1]
                best = min(best, (e + (part[j - 1] != c), s))
            if j in cost:
                best = min(best, (cost[j][0] + 1, cost[j][1]))
            if j - 1 in row:
                best = min(best, (row[j - 1][0] + 1, row[j - 1][1]))
            if best[0] <= k:
                row[j] = best
        if not row:
            return None
        cost = row
    e, j = min((e, j) for j, (e, _) in cost.items())
    return e, lo + cost[j][1], lo + j


def fewest_edits(item: np.ndarray, text: np.ndarray, starts: np.ndarray, length: int, low: int, width: int, k: int) -> np.ndarray:
    """For each start the edits that ``align`` would find for ``length`` characters of ``item`` from there, all at once; ``low`` is
    a diagonal of the whole item."""
    far, cell = 1 << 20, np.arange(width + 2 * k + 1)
    place = starts[:, None] + low - k + cell  # characters of the text that are read at row 0
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    for i in range(length):
        place = place + 1
        inside = (place >= 0) & (place <= len(text))
        same = text[np.clip(place - 1, 0, len(text) - 1)] == item[starts + i][:, None]
        row = np.where(place > 0, cost + ~same, far)
        row[:, :-1] = np.minimum(row[:, :-1], cost[:, 1:] + 1)
        row = np.where(inside, row, far)
        cost = np.where(inside, np.minimum.accumulate(row - cell, axis=1) + cell, far)
    return cost.min(axis=1)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05, segment: int = 100, max_index_chars: int = 2_000_000) -> DataFrame:
    """A row per document and item of which it holds a segment: doc_id, item_id, n_segments, edits, start, end.

    A segment is a whole item of at most ``segment`` characters, or ``segment`` characters of a longer one at every half of
    it, in lower case with single spaces; where a document holds none of an item's, any other stretch of ``segment`` characters
    of the item counts like one, but n_segments is 0. Up to ``rate`` of its length may differ by edits, fewer where it is so short that
    the q-gram bound would be empty; below q characters it must stand there exactly. n_segments counts those held, edits
    is the fewest of any, start and end are places in the normalised text of the first held segment. Null texts and
    items are empty and match nothing; repeated document rows give a row each; a null item_id shows as -1;
    further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-int(total) // max_index_chars))
    out = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        shared = spark.sparkContext.broadcast(sorted((r.item_id if r.item_id is not None else -1, r.text) for r in rows.collect()))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
            _scanner(shared, q, rate, segment), "doc_id long, item_id long, n_segments int, edits int, start long, end long"
        )
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(shared, q: int, rate: float, segment: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("index")
        index = Index(shared.value, q, rate, segment)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = normal(text.as_py())
                held: dict[tuple[int, int], tuple] = {}
                for s in index.short:
                    at = t.find(index.text[s])
                    if at >= 0:
                        held[index.item[s], s] = (0, at, at + len(index.text[s]))
                codes = _codes(t)
                at, found = index.hits(codes)
                for s, low in index.candidates(at, found):
                    k = int(index.k[s])
                    got = align(index.text[s], t, low, 2 * (k + 1), k)
                    if got is not None and got < held.get((index.item[s], s), (k + 1, 0, 0)):
                        held[index.item[s], s] = got
                between: dict[int, list[tuple]] = {}
                for x, low, starts in index.stretches(at, found, {i for i, _ in held}):
                    (item, whole), k = index.whole[x], index.whole_k
                    edits = fewest_edits(_codes(whole), codes, starts, segment, low, 2 * (k + 1), k)
                    if edits.min() <= k:
                        first = int(starts[np.flatnonzero(edits <= k)[0]])
                        _, start, end = align(whole[first : first + segment], t, low + first, 2 * (k + 1), k)
                        between.setdefault(item, []).append((int(edits.min()), start, end))
                for item, own in sorted(between.items()):
                    first = min(own, key=lambda v: (v[1], v[2]))
                    rows.append((doc_id, item, 0, min(v[0] for v in own), first[1], first[2]))
                for item in sorted({i for i, _ in held}):
                    own = [v for (i, _), v in held.items() if i == item]
                    first = min(own, key=lambda v: (v[1], v[2]))
                    rows.append((doc_id, item, len(own), min(v[0] for v in own), first[1], first[2]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_segments", "edits", "start", "end"])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a segment of the benchmark; all other rows and columns stay.

    A document whose doc_id is null is kept or dropped with all other rows of a null doc_id.
    """
    leaks = find_leaks(docs, benchmark, **options).select("doc_id").distinct()
    leak = leaks.select(F.col("doc_id").alias("_leak"))
    return docs.join(leak, docs["doc_id"].eqNullSafe(leak["_leak"]), "left_anti")
