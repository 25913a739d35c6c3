"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` has one or two random pseudo-rotations (three rounds of random signs and a fast Hadamard transform); each sends a
vector to the nearest signed axis, and the axes of a table are its bucket. A query looks into the buckets of the nearest axes of every
table, and what it meets is ranked by the exact inner product. How many buckets it probes falls with the number of vectors, and where
buckets grow large a second axis divides them (``plan_of``).

The largest inner products are the smallest angles only among vectors of one length, so vectors lie in bands of norms, each a factor of
2 ** (1 / 4) wide and hashed by itself. A query first looks into the bands of the longest vectors, some ``50 * k`` of them or more; what it finds bounds its
k-th best, and of the other bands it visits those whose longest vector could still reach that bound. Vectors of one length are one
band. A query that has met fewer than ``k`` vectors in all is compared with all vectors.

Vectors are dealt by band, table and first axis, each once a table. There are few such cells (bands times tables times signed axes), so their sizes are
known to the driver; one of more than ``block`` vectors or queries is split, each pair of blocks being one task's matrix products.
Equal vectors are one class with its smallest ids, of which no answer can need more than k + 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def usable(v: Column) -> Column:
    """Neither null, empty, zero nor holding null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Rotations:
    def __init__(self, dim: int, tables: int, seed: int):
        self.d = 1 << max(0, (dim - 1).bit_length())
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, 3, self.d))

    def axes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the rotated rows against all signed axes: column 2 * axis for +, 2 * axis + 1 for -."""
        full = np.zeros((len(x), self.d))
        full[:, : x.shape[1]] = x
        for rounds in self.signs:
            y = full
            for s in rounds:
                y = hadamard(y * s)
            yield np.stack([y, -y], axis=2).reshape(len(x), 2 * self.d)


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in an Arrow list column without nulls."""
    length = column.value_lengths().to_numpy()
    flat, start = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(length)[:-1]])
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _axes_of(x: np.ndarray, rotations: Rotations, tables: range, depth: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each table the ``depth`` matrices of the unit rows against its signed axes."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    own: list[np.ndarray] = []
    for i, y in enumerate(rotations.axes(x)):
        own.append(y)
        if len(own) == depth:
            yield tables[i // depth], own
            own = []


def _best_probes(axes: list[np.ndarray], first: int, probes: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, first axis, second axes) of the ``probes`` pairs of axes that lie nearest to each row, of its ``first`` nearest first axes; by
    the summed squares of what an axis lacks to the nearest one."""
    a, b = ((y.max(axis=1, keepdims=True) - y) ** 2 for y in axes)
    near = np.argpartition(a, min(first, a.shape[1]) - 1, axis=1)[:, :first]
    for i in range(len(a)):
        total = (a[i, near[i]][:, None] + b[i]).ravel()
        take = np.argpartition(total, min(probes, len(total)) - 1)[:probes]
        row, second = take // b.shape[1], take % b.shape[1]
        for j in np.unique(row):
            yield i, int(near[i, j]), np.sort(second[row == j])


def plan_of(n: int, axes: int, block: int) -> tuple[int, int, int]:
    """(axes a table, first axes probed, pairs of axes probed) for ``n`` vectors and ``axes`` signed axes. The nearest of more vectors lie
    nearer, so fewer buckets need be probed; from a quarter of a block a bucket on, a second axis divides the buckets."""
    first = max(4, min(axes, math.ceil(axes * 0.17 * (10_000 / max(n, 1)) ** 0.2)))
    if n < axes * block / 4:
        return 1, first, 0
    share = 3.6 * n**-0.25 / 5
    return 2, min(axes, 3 * first), max(16, math.ceil(axes * axes * share))


Bands = dict[int, list[tuple[int, int, float]]]


def _norm(v: Column) -> Column:
    """Euclidean norm, of numbers of any size."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 5, block: int = 4096, seed: int = 7, compared: Accumulator | None = None) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) found for each row of ``queries`` (the same columns): query_id, rank from
    1, vec_id, score.

    Score is the inner product in double precision, summed from the first component on; equal scores go to the smaller
    vec_id, and a row of the query's own vec_id is no candidate. Rows with a null vec_id or an unusable vector take no
    part, vectors of different length never meet, repeated rows count once, further columns are ignored. A query gets
    fewer than ``k`` rows only where there are fewer vec_ids of its dimension. ``compared`` counts the inner products made.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    single = all(dict(df.dtypes)["embedding"] == "array<float>" for df in (vectors, queries))
    rows = clean(vectors).distinct().withColumn("h", F.xxhash64("v"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("norm", _norm(F.col("v")))
    classes = stored(classes.withColumn("band", F.floor(4 * F.log2("norm") + 0.5).cast("int")), "classes")
    bands = classes.groupBy(F.size("v").alias("dim"), "band").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()  # a row a band
    classes = classes.select("v", "ids", F.lit(None).cast("long").alias("q"), F.lit(0.0).alias("low"), "band")
    asked = clean(queries).distinct().select("v", F.array().cast("array<long>").alias("ids"), F.col("vec_id").alias("q"), F.lit(float("-inf")).alias("low"), F.lit(0).alias("band"))
    long: Bands = {}
    rest: Bands = {}
    for r in sorted(bands, key=lambda r: -r.band):
        enough = sum(n for _, n, _ in long.get(r.dim, [])) >= 50 * k
        (rest if enough else long).setdefault(r.dim, []).append((r.band, r.n, r.most))
    run = lambda asked, bands: _answers(classes, asked, k, tables, block, seed, bands, "<f4" if single else "<f8", compared)
    met = stored(run(asked, long), "nearest")
    if rest:
        kth = met.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
        bound = asked.join(kth, asked["q"] == kth["query_id"], "left").select("v", "ids", "q", F.coalesce("kth", "low").alias("low"), "band")
        both = met.drop("rank").unionByName(run(bound, rest).drop("rank")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        met = stored(both.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    full = met.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = asked.join(full, asked["q"] == full["query_id"], "left_anti")  # met fewer than k vectors
    if short.isEmpty():
        return met
    return met.join(full, "query_id", "left_semi").unionByName(run(short, None))


def _answers(classes: DataFrame, asked: DataFrame, k: int, tables: int, block: int, seed: int, bands: Bands | None, kind_of: str, compared: Accumulator | None = None) -> DataFrame:
    """The answers to ``asked`` among the vectors of ``bands`` (by dimension: band, number of vectors, largest norm), no worse than each query's
    ``low``; without bands all vectors of a dimension are one bucket. Vectors travel as bytes of ``kind_of``."""
    spark = classes.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    def hashed(kind: int):
        """kind 0: of vectors; 1: of queries. Yields (dim, band, vectors, row numbers, buckets, second axes or none, rows' hashes)."""

        def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
            low, of = b.column(3).to_numpy(), b.column(4).to_numpy()
            for at, x in _by_dim(b.column(0)):
                dim = x.shape[1]
                salt = (np.ascontiguousarray(x).view(np.uint64) * np.arange(1, 2 * dim, 2, dtype=np.uint64)).sum(axis=1)
                salt = (((salt ^ (salt >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64)
                if bands is None:
                    yield dim, 0, x, at, np.full(len(at), -1), [b""] * len(at), salt
                    continue
                d = 1 << max(0, (dim - 1).bit_length())
                size = np.linalg.norm(x / np.abs(x).max(axis=1)[:, None], axis=1) * np.abs(x).max(axis=1)
                for band, n, most in bands.get(dim, []):
                    with np.errstate(over="ignore"):
                        mine = np.flatnonzero(of[at] == band if kind == 0 else most * size * (1 + 1e-9) >= low[at])
                    if len(mine):
                        depth, first, probes = plan_of(n, 2 * d, block)
                        for got in in_band(kind, x[mine], d, depth, first, probes):
                            where, bucket, codes = got
                            yield dim, band, x[mine[where]], at[mine[where]], bucket, codes, salt[mine[where]]

        return rows_of

    def in_band(kind: int, x: np.ndarray, d: int, depth: int, first: int, probes: int) -> Iterator[tuple]:
        """(rows, buckets, second axes or none) of vectors or queries in each table of a band."""
        every = np.arange(len(x))
        for t, axes in _axes_of(x, Rotations(x.shape[1], tables * depth, seed), range(tables), depth):
            base = t * (1 << 20)
            if kind == 0:
                second = axes[1].argmax(axis=1).astype("<u4") if depth == 2 else None
                yield every, base + axes[0].argmax(axis=1), [b""] * len(x) if second is None else [c.tobytes() for c in second]
            elif depth == 1:
                near = np.argpartition(-axes[0], min(first, 2 * d) - 1, axis=1)[:, :first]
                for c in range(near.shape[1]):
                    yield every, base + near[:, c], [b""] * len(x)
            else:
                i, one, two = zip(*_best_probes(axes, first, probes), strict=True)
                yield np.array(i), base + np.array(one), [c.astype("<u4").tobytes() for c in two]

    def count(kind: int):
        rows_of = hashed(kind)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[tuple[int, int, int], int] = {}
            for b in batches:
                for dim, band, _, _, bucket, _, _ in rows_of(b):
                    for x, n in zip(*np.unique(bucket, return_counts=True), strict=True):
                        got[dim, band, int(x)] = got.get((dim, band, int(x)), 0) + int(n)
            if got:
                yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.int32()) for i in range(3)), pa.array(list(got.values()), pa.int64())], names=["dim", "band", "bucket", "n"])

        return go

    sizes = []
    for kind, df in ((0, classes), (1, asked)):
        got = df.mapInArrow(count(kind), "dim int, band int, bucket int, n long").groupBy("dim", "band", "bucket").agg(F.sum("n").alias("n")).collect()
        sizes.append({(r.dim, r.band, r.bucket): -(-r.n // block) for r in got})
    shared = spark.sparkContext.broadcast(sizes)  # a number for each bucket: bands times tables times signed axes

    def deal(kind: int):
        rows_of = hashed(kind)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, other = shared.value[kind], shared.value[1 - kind]
            for b in batches:
                for dim, band, x, at, bucket, codes, salt in rows_of(b):
                    parts = np.array([own.get((dim, band, int(c)), 1) for c in bucket])
                    copies = np.array([other.get((dim, band, int(c)), 0) for c in bucket])
                    salt = salt % parts  # of the vector itself: the same whenever a task runs again
                    take = np.repeat(np.arange(len(at)), copies)
                    across = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
                    cells = (salt[take], across) if kind == 0 else (across, salt[take])
                    for s in range(0, len(take), 8192):
                        part = take[s : s + 8192]
                        pick = pa.array(at[part])
                        data = np.ascontiguousarray(x[part].astype(kind_of))
                        edge = np.arange(len(part) + 1, dtype=np.int32) * (data.itemsize * dim)
                        v = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edge), pa.py_buffer(data)])
                        yield pa.RecordBatch.from_arrays([v, b.column(1).take(pick), b.column(2).take(pick), pa.array([codes[i] for i in part], pa.binary()), b.column(3).take(pick), pa.array([dim] * len(part), pa.int32()), pa.array([band] * len(part), pa.int32()), pa.array(bucket[part], pa.int32()), pa.array(cells[0][s : s + 8192], pa.int32()), pa.array(cells[1][s : s + 8192], pa.int32())], names=["v", "ids", "q", "codes", "low", "dim", "band", "bucket", "x", "y"])

        return go

    schema = "v binary, ids array<long>, q long, codes binary, low double, dim int, band int, bucket int, x int, y int"
    dealt = classes.mapInArrow(deal(0), schema).unionByName(asked.mapInArrow(deal(1), schema))

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
        return out

    def match(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q, low = t.column("q").fill_null(0).to_numpy(), t.column("low").to_numpy()
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), kind_of).reshape(len(q), -1).astype(float)
        ids, codes = t.column("ids").to_pylist(), t.column("codes").to_pylist()
        is_class = np.array([len(i) > 0 for i in ids])
        own, ask = np.flatnonzero(is_class), np.flatnonzero(~is_class)
        second = np.array([np.frombuffer(codes[i], "<u4")[0] if codes[i] else 0 for i in own], np.int64)
        own = own[np.argsort(second, kind="stable")]
        edge = np.searchsorted(np.sort(second), np.arange(second.max(initial=0) + 2))
        out_q, out_ids, out_scores = [], [], []
        data = v[own]
        slack = 1e-9 * np.linalg.norm(v[ask], axis=1) * np.linalg.norm(data, axis=1).max(initial=0)

        def close(rows: np.ndarray, part: slice) -> None:
            """The best of ``rows`` (numbers in ``ask``) among a slice of the vectors."""
            some = data[part]
            if compared is not None:
                compared.add(len(rows) * len(some))
            near = v[ask[rows]] @ some.T
            kk = min(k + 1, len(some))
            limit = np.maximum(-np.partition(-near, kk - 1, axis=1)[:, kk - 1], low[ask[rows]]) - slack[rows]
            r, c = np.nonzero(near >= limit[:, None])
            score = exact(v[ask[rows[r]]], some[c])
            cut = np.searchsorted(r, np.arange(len(rows) + 1))
            for i, row in enumerate(rows):
                mine = q[ask[row]]
                got = sorted((-score[j], x) for j in range(cut[i], cut[i + 1]) for x in ids[own[part.start + c[j]]] if x != mine)[:k]
                if got:
                    out_q.append(mine)
                    out_ids.append([x for _, x in got])
                    out_scores.append([-s for s, _ in got])

        if len(own) and len(ask):
            wanted = [np.frombuffer(codes[i], "<u4") for i in ask]
            whole = np.array([len(w) == 0 for w in wanted])
            jobs = [(np.flatnonzero(whole), slice(0, len(own)))]
            if not whole.all():
                row = np.repeat(np.arange(len(ask)), [len(w) for w in wanted])
                code = np.concatenate(wanted).astype(np.int64)
                order = np.argsort(code, kind="stable")
                row, code = row[order], code[order]
                for c in np.unique(code[code < len(edge) - 1]):
                    if edge[c + 1] > edge[c]:
                        jobs.append((row[np.searchsorted(code, c) : np.searchsorted(code, c, "right")], slice(int(edge[c]), int(edge[c + 1]))))
            for rows, part in jobs:
                for s in range(0, len(rows), 256):
                    close(rows[s : s + 256], part)
        return pa.table({"q": pa.array(out_q, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())), "scores": pa.array(out_scores, pa.list_(pa.float64()))})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(q: int, ids: list, scores: list) -> pa.RecordBatch:
            x, at = np.unique(np.concatenate(ids), return_index=True)
            s = np.concatenate(scores)[at]
            order = np.lexsort((x, -s))[:k]
            return pa.RecordBatch.from_arrays([pa.array([q] * len(order), pa.int64()), pa.array(np.arange(1, len(order) + 1), pa.int32()), pa.array(x[order], pa.int64()), pa.array(s[order], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        now, ids, scores = None, [], []
        for b in batches:
            for q, i, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if q != now:
                    if ids:
                        yield close(now, ids, scores)
                    now, ids, scores = q, [], []
                ids.append(i.values.to_numpy())
                scores.append(s.values.to_numpy())
        if ids:
            yield close(now, ids, scores)

    found = dealt.groupBy("dim", "band", "bucket", "x", "y").applyInArrow(match, "q long, ids array<long>, scores array<double>")
    return found.repartition(n_tasks, "q").sortWithinPartitions("q").mapInArrow(best, "query_id long, rank int, vec_id long, score double")
