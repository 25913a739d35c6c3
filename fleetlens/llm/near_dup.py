"""MinHash near-duplicates with tensored banding.

A document has two collections of ``half_keys`` short keys of ``rows`` minhashes each; every pair of one key from either
collection makes a table key. So 2 * half_keys * rows minhashes serve half_keys ** 2 tables of 2 * rows minhashes. Two
documents of similarity s miss each other with a chance of at most 2 * (1 - s ** rows) ** half_keys: with 3 rows 2e-4 at
0.85 with 10 keys, 4e-4 at 0.8 with 12.

Documents of one set are one class. Documents that share table keys are joined to rough groups, without pairs: each
key joins its members to its first one, in the partition before the shuffle and once more after it. Inside a group
the sets meet in blocks of bounded size, so that large groups are split over tasks; in a pair of blocks those that share one of their
rarest shingles are candidates, and every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, take_turn
from .components import components
from .decontaminate import gram_hashes
from .substring import _spread, word_hashes

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of ``width``-word shingles, A-Z in lower case; all words as one where there are fewer."""
    codes = word_hashes(text.lower())
    if not len(codes):
        return np.empty(0, np.uint64)
    return np.unique(_spread(gram_hashes(codes, min(width, len(codes))) + np.uint64(min(width, len(codes))), *_MIX))


class MinHash:
    def __init__(self, half_keys: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half_keys, self.rows = half_keys, rows
        self.a = rng.integers(0, 1 << 63, 2 * half_keys * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def half(self, s: np.ndarray) -> np.ndarray:
        """2 * half_keys keys of the set."""
        low = np.empty(len(self.a), np.uint64)
        for i, a in enumerate(self.a):
            y = s * a
            low[i] = (y ^ (y >> np.uint64(32))).min()
        low = _spread(low, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53).reshape(-1, self.rows)
        out = np.zeros(len(low), np.uint64)
        for c in range(self.rows):
            out = _spread(out * np.uint64(31) + low[:, c], *_MIX)
        return out

    def keys(self, half: np.ndarray) -> np.ndarray:
        """The table keys of (n, 2 * half_keys) short keys: n rows of half_keys ** 2."""
        m = self.half_keys
        table = np.arange(m * m, dtype=np.uint64)
        left, right = half[:, :m].repeat(m, axis=1), np.tile(half[:, m:], (1, m))
        return _spread(left * np.uint64(3) + (right ^ np.uint64(_MIX[0])) * np.uint64(5) + table, *_MIX)


def _rough_edges(classes: DataFrame, mh: MinHash, tasks: int) -> DataFrame:
    """(a, b): members of a table key joined to a first member."""

    def emit(ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, doc = keys.ravel(), np.repeat(ids, keys.shape[1])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = doc[new][np.cumsum(new) - 1]
        # b is null: a key's first document of this partition; else an edge inside the partition
        pairs = np.unique(np.stack([doc[~new], first[~new]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], names=["k", "a", "b"])
        k, d = key[new].view(np.int64), doc[new]
        for s in range(0, len(k), 100_000):
            part = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(d[part]), pa.nulls(len(k[part]), pa.int64())], names=["k", "a", "b"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, half, n = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            half.append(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, 2 * mh.half_keys))
            n += b.num_rows
            if n >= 4096:
                yield from emit(np.concatenate(ids), mh.keys(np.concatenate(half)))
                ids, half, n = [], [], 0
        if n:
            yield from emit(np.concatenate(ids), mh.keys(np.concatenate(half)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for b in batches:
            k, a = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = len(k) > 0 and k[0] != key
            run = np.cumsum(new)
            firsts = np.concatenate([[first if first is not None else -1], a[new]])[run]
            if len(k):
                pairs = np.unique(np.stack([a[~new], firsts[~new]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
                key, first = k[-1], firsts[-1]

    dealt = stored(classes.select("id", "half").mapInArrow(deal, "k long, a long, b long"), "table-keys")
    local = dealt.filter("b is not null").select("a", "b")
    across = dealt.filter("b is null").select("k", "a").repartition(tasks, "k").sortWithinPartitions("k", "a").mapInArrow(join, "a long, b long")
    return local.unionByName(across).distinct()


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each set the number of the first one that links lead to, links being tried between ``left`` and ``right`` members:
    100 * intersection >= percent * union.

    Two sets that link share one of their rarest shingles: of n, the (100 - percent) % and one more. Those that do are candidates,
    unless a chain of links joins them already, and are compared in full.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, doc = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    word = rank[word]
    word = word[np.lexsort((word, doc))]  # of each set the rarest first
    start = np.concatenate([[0], np.cumsum(size)])
    head = size - -(-percent * size // 100) + 1
    rare = np.arange(len(word)) - start[doc] < head[doc]
    posted, owner = word[rare & right[doc]], doc[rare & right[doc]]
    order = np.argsort(posted, kind="stable")
    owner, edge = owner[order], np.searchsorted(posted[order], np.arange(len(times) + 1))
    mark, label = np.zeros(len(times), bool), np.arange(n)

    def ranges(first: np.ndarray, width: np.ndarray) -> np.ndarray:
        return np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())

    for i in np.flatnonzero(left):
        w = word[start[i] : start[i] + head[i]]
        c = np.unique(owner[ranges(edge[w], edge[w + 1] - edge[w])])
        c = c[(label[c] != label[i]) & (100 * np.minimum(size[c], size[i]) >= percent * np.maximum(size[c], size[i]))]
        if not len(c):
            continue
        mine = word[start[i] : start[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[word[ranges(start[c], size[c])]], np.concatenate([[0], np.cumsum(size[c])[:-1]]), dtype=np.int64)
        mark[mine] = False
        near = c[100 * both >= percent * (size[c] + size[i] - both)]
        if len(near):
            merged = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, merged)] = merged[0]
    return label


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, half_keys: int = 12, rows: int = 3, block: int = 1_000_000, stable: bool = False) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id that links lead to, itself included), kept.

    A document's set holds its ``width``-word shingles, as 64-bit hashes, over words without ASCII white space, A-Z in lower
    case; with fewer words, the whole sequence. Documents link where 100 * intersection >= percent * union. Null and empty
    texts have an empty set and link to nothing. A null doc_id is a document of its own with a null component, kept.
    Rows of one doc_id are one node with the links of all of them; further columns are ignored. ``block``: shingles of the sets that a
    task compares with as many others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mh = MinHash(half_keys, rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("words")
        for b in batches:
            n, h, half = [], [], []
            for text in b.column(1):
                s = shingles(bytes(text.as_buffer()), width)
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                half.append(mh.half(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(half, pa.binary())], names=["doc_id", "n", "h", "half"])

    signed = stored(base.mapInArrow(sign, "doc_id long, n long, h binary, half binary"), "signatures")
    real = signed.filter("n > 0 and doc_id is not null")
    same = real.groupBy("h").agg(F.min("doc_id").alias("id"))
    classes = real.join(same, "h").filter("doc_id = id").select("id", "half", "n").dropDuplicates(["id", "half"])
    rough = components(_rough_edges(classes, mh, tasks))
    size = rough.join(classes.select("id", "n"), "id").groupBy("component").agg(F.sum("n").alias("size"))
    groups = stored(rough.join(size, "component").select("id", F.col("component").alias("c"), F.ceil(F.col("size") / block).cast("int").alias("blocks")), "groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("words")
        for b in batches:
            s = [shingles(bytes(t.as_buffer()), width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(s, pa.binary())], names=["id", "c", "blocks", "s"])

    members = base.join(groups, base["doc_id"] == groups["id"]).select("id", "text", "c", "blocks").mapInArrow(sets, "id long, c long, blocks int, s binary")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "c", "s", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def confirm(t: pa.Table) -> pa.Table:
        ids, x, y = t.column("id").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        order = np.argsort(ids, kind="stable")
        data = t.column("s").to_pylist()
        found = [np.frombuffer(data[i], np.uint64) for i in order]
        own = t.column("own").to_numpy()[order]
        label = linked(found, own == x, own == y, percent)
        ids = ids[order]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[label[moved]], pa.int64())})

    links = dealt.groupBy("c", "x", "y").applyInArrow(confirm, "a long, b long")
    # one document of each class stands for the rest
    alike = real.join(same, "h").filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(links.unionByName(alike))
    out = signed.join(found, signed["doc_id"] == found["id"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
