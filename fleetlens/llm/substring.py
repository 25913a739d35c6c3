"""Repeated word windows, found through merged count-min sketches and then grouped exactly.

Pass 1 counts every window of every partition in a two-row sketch; the partitions' sketches travel as gap-coded cells and
are merged block by block. A window whose cells are not both counted twice occurs once, so nothing is lost by dropping
it. Pass 2 groups the rest by a 96-bit hash: each fragment of documents sends one record per distinct window with its
smallest doc_id, so a window that a third of all documents hold is a record per fragment, not per document. The answer
is one bit per record: does a smaller doc_id hold the window elsewhere? Pass 3 lays these bits on the fragment's words.

The sketch has at most 2 ** ``MAX_BITS`` cells a row (64 MB of bits in all, the size that is broadcast). A larger corpus fills
it, which lets more windows through to pass 2 and changes no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, take_turn
from .decontaminate import gram_hashes

MAX_BITS = 28
_BLOCK_BITS = 20
#: Documents of a fragment: 2 ** FRAGMENT_BITS rows of one partition.
FRAGMENT_BITS = 10
_FLUSH = 4_000_000
#: A text of more bytes is a fragment of its own.
_LONG_TEXT = 1 << 16
#: Windows of a bucket of the exact grouping, if the sketch lets all through.
_BUCKET = 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).max

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE_RE = re.compile(rb"[\t-\r ]")
_BYTE = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_ODD = 0x9E3779B97F4A7C15
_PIECE = 1 << 16
_UP = np.cumprod(np.full(_PIECE, _ODD, np.uint64))
_DOWN = np.cumprod(np.full(_PIECE, pow(_ODD, -1, 1 << 64), np.uint64))
_LONG_WORD = 64


def _spread(x: np.ndarray, a: int, b: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(a)
    return (x ^ (x >> np.uint64(29))) * np.uint64(b)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut at white space into pieces of at most ``_PIECE`` bytes; a longer word is a piece of its own."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        if end < len(raw):
            space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, end - at, at)])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                found = _SPACE_RE.search(raw, end)
                end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order: a polynomial over its bytes by differences of prefix sums; words of more than 64 bytes, where
    such hashes could be made to collide, by another hash."""
    if len(raw) > _PIECE:
        return np.concatenate([word_hashes(p) if len(p) <= _PIECE else np.array([xxhash.xxh3_64_intdigest(p.strip())], np.uint64) for p in _pieces(raw)])
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[b], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _UP[: len(b)], out=sums[1:])
    size = end - start
    h = _spread((sums[end] - sums[start]) * _DOWN[start] + size.astype(np.uint64), 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


def window_hash(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of every ``window`` neighbouring codes."""
    return _spread(gram_hashes(codes, window), 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def second_hash(codes: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the windows that start ``at`` some places."""
    own = _spread(codes, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
    out = np.zeros(len(at), np.uint64)
    for i in range(window):
        out = out * _FACTOR + own[at + i]
    return (_spread(out, 0x94D049BB133111EB, 0xD6E8FEB86659FD93) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each window in either row of the sketch."""
    shift = np.uint64(64 - bits)
    return h >> shift, _spread(h, 0x94D049BB133111EB, 0xD6E8FEB86659FD93) >> shift


def pack_gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct cells below 2 ** 32 as gaps in bytes; 255 means 255 and more to come."""
    gap = np.diff(cells, prepend=0)
    more = gap // 255
    out = np.full(int(more.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.cumsum(a, dtype=np.int64)[a != 255]


def merge_blocks(block_bits: int):
    """Merges counted cells (k, once, more), sorted by block k, into the bits of the cells that are counted twice or more; holds one block."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(0, np.uint8)
        bits = lambda: pa.RecordBatch.from_pydict({"k": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})
        for b in batches:
            for k, once, more in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if now is not None:
                        yield bits()
                    now, counts = k, np.zeros(1 << block_bits, np.uint8)
                at = unpack_gaps(once)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[unpack_gaps(more)] = 2
        if now is not None:
            yield bits()

    return merge


def sketch(docs: DataFrame, window: int, bits: int) -> list[bytes]:
    """For each of two rows the bits of the cells that are counted twice or more, over all partitions of (.., text)."""
    block_bits = min(bits, _BLOCK_BITS)

    def emit(h: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, x in enumerate(h):
            cells, count = np.unique(x, return_counts=True)
            cells = cells.astype(np.int64)
            block = cells >> block_bits
            edge = np.searchsorted(block, np.arange((1 << (bits - block_bits)) + 1))
            out = []
            for b in range(1 << (bits - block_bits)):
                part = cells[edge[b] : edge[b + 1]] - (b << block_bits)
                if len(part):
                    out.append((row << 16 | b, pack_gaps(part), pack_gaps(part[count[edge[b] : edge[b + 1]] > 1])))
            if out:
                k, once, more = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["k", "once", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("words")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            for text in b.column(0):
                codes = word_hashes(bytes(text.as_buffer() or b""))
                if len(codes) >= window:
                    one, two = cells(window_hash(codes, window), bits)
                    held.append((one.astype(np.uint32), two.astype(np.uint32)))
                    n += len(one)
                if n >= _FLUSH:
                    yield from emit([np.concatenate(x) for x in zip(*held, strict=True)])
                    held, n = [], 0
        if held:
            yield from emit([np.concatenate(x) for x in zip(*held, strict=True)])

    counted = docs.select("text").mapInArrow(count, "k int, once binary, more binary")
    rows = counted.repartition("k").sortWithinPartitions("k").mapInArrow(merge_blocks(block_bits), "k int, bits binary").collect()  # the bits of the sketch
    out = [bytearray((1 << bits) // 8) for _ in range(2)]
    for r in rows:
        at = (r.k & 0xFFFF) << block_bits >> 3
        out[r.k >> 16][at : at + len(r.bits)] = r.bits
    return [bytes(x) for x in out]


def hash_order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The order by h, then g: one sort by h, and a second only where two of one h differ in g."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    return np.lexsort((g, h)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


class Fragment:
    """The possibly repeated windows of some documents: distinct ones in hash order with their smallest doc_id."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int, sketches: list[np.ndarray], bits: int):
        hs, gs, docs, places, self.words = [], [], [], [], []
        for d, text in enumerate(texts):
            codes = word_hashes(text)
            self.words.append(len(codes))
            if len(codes) < window:
                continue
            h = window_hash(codes, window)
            once = [s[c >> np.uint64(3)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8) for s, c in zip(sketches, cells(h, bits), strict=True)]
            at = np.flatnonzero(once[0] & once[1] & 1)
            hs.append(h[at])
            gs.append(second_hash(codes, window, at))
            docs.append(np.full(len(at), d))
            places.append(at)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h, g, self.doc, self.place = join(hs, np.uint64), join(gs, np.uint32), join(docs, np.int64), join(places, np.int64)
        self.id = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        order = hash_order(h, g)
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.group = np.empty(len(h), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.h, self.g = h[new], g[new]
        self.low = np.minimum.reduceat(self.id[self.doc[order]], np.flatnonzero(new)) if len(h) else np.empty(0, np.int64)

    def bucket_edges(self, buckets: int) -> np.ndarray:
        limit = [np.uint64(-(-(b << 64) // buckets)) for b in range(1, buckets)]
        return np.concatenate([[0], np.searchsorted(self.h, np.array(limit, np.uint64)), [len(self.h)]]).astype(np.int64)


def _loaded(shared) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in shared.value]


def remove_repeats(docs: DataFrame, window: int = 13, stable: bool = False, bits: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept (its words that no earlier document repeats, joined by spaces).

    Removes each word that a window of ``window`` words covers whose sequence also starts in a document of a smaller
    doc_id, judged on the input. Words are runs without ASCII white space; null and empty texts have none. A null
    doc_id counts as the largest; rows of one doc_id never remove each other's words; further columns are ignored.
    ``stable`` says that ``docs`` is a plain scan that comes out in the same partitions and order each time; otherwise a
    copy is written to the shared folder first. Two different windows count as one with a chance of 2 ** -96 a pair. ``bits``: the sketch
    has two rows of 2 ** bits cells, by default two or more for each window but at most ``MAX_BITS``; executors with memory for
    2 ** (bits - 2) bytes may be given more, up to 32.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    number = F.monotonically_increasing_id()
    rows = rows.withColumn("f", F.when(F.octet_length("text") > _LONG_TEXT, -1 - number).otherwise(F.shiftright(number, FRAGMENT_BITS)))
    if not stable:
        rows = stored(rows, "documents")
    words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // 6
    if bits is None:
        bits = min(MAX_BITS, max(12, math.ceil(math.log2(words + 2)) + 1))
    shared = spark.sparkContext.broadcast(sketch(rows, window, bits))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // _BUCKET)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("words")
        sketches = _loaded(shared)

        def one(f: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            x = Fragment(ids, texts, window, sketches, bits)
            edge = x.bucket_edges(buckets)
            at = [b for b in range(buckets) if edge[b + 1] > edge[b]]
            if at:
                cut = lambda a: pa.array([a[edge[b] : edge[b + 1]].tobytes() for b in at], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([f] * len(at), pa.int64()), cut(x.h), cut(x.g), cut(x.low)], names=["b", "f", "h", "g", "low"])

        now, ids, texts = None, [], []
        for batch in batches:
            for f, i, t in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if f < 0:  # stands between the texts of another fragment
                    yield from one(f, [i], [t])
                    continue
                if f != now:
                    if ids:
                        yield from one(now, ids, texts)
                    now, ids, texts = f, [], []
                ids.append(i)
                texts.append(t)
        if ids:
            yield from one(now, ids, texts)

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        h, g, low = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("g", np.uint32), ("low", np.int64)))
        order = hash_order(h, g)
        hs, gs = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
        least = np.empty(len(h), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = least < low
        end = np.cumsum([len(x) // 8 for x in t.column("h").to_pylist()])
        parts = np.split(earlier, end[:-1])
        keep = [i for i, p in enumerate(parts) if p.any()]
        return pa.table({"f": pa.array([t.column("f")[i].as_py() for i in keep], pa.int64()), "b": pa.array([key[0].as_py()] * len(keep), pa.int32()), "bits": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())})

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        take_turn("words")
        ids, texts = left.column("doc_id").to_pylist(), left.column("text").cast(pa.binary()).to_pylist()
        x = Fragment(ids, texts, window, _loaded(shared), bits)
        edge = x.bucket_edges(buckets)
        earlier = np.zeros(len(x.h), bool)
        for b, data in zip(right.column("b").to_pylist(), right.column("bits").to_pylist(), strict=True):
            n = edge[b + 1] - edge[b]
            earlier[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8))[:n]
        hit = earlier[x.group] | (x.low[x.group] < x.id[x.doc])
        doc, place = x.doc[hit], x.place[hit]
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        removed, kept = [], []
        for d, (n, text) in enumerate(zip(x.words, texts, strict=True)):
            words = text.split()  # bytes are split at the six white-space characters
            at = place[edge[d] : edge[d + 1]]
            if len(at):
                change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + window, minlength=n + 1)[: n + 1]
                out = np.cumsum(change)[:n] > 0
                removed.append(int(out.sum()))
                words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(x.words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).view(pa.string())})

    bits_back = rows.mapInArrow(records, "b int, f long, h binary, g binary, low binary").groupBy("b").applyInArrow(answer, "f long, b int, bits binary")
    return rows.groupBy("f").cogroup(bits_back.groupBy("f")).applyInArrow(lay, "doc_id long, n_words long, n_removed long, kept string")


