"""Quality by random-indexing word vectors, pooled per document, under a small two-layer network with calibrated probabilities.

Random indexing gives each word a sparse random vector of a few +1 and -1; a word's own vector is the sum of those of its neighbours
over the whole corpus. Words are hashed to 2 ** ``bits`` rows, so the counts of a partition are one matrix of fixed size; the matrices
are merged by blocks of rows as streams, first within groups of partitions. Whole numbers are added, so vectors do not depend on the order.

A document is the mean of its words' unit vectors, the mean product of neighbouring ones (which sees words and lines that repeat) and the
logarithm of its length. The network learns from a bounded sample of labelled rows; a fifth of them, kept aside, sets the temperature
that its logits are divided by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, take_turn

_PIECE = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.full(_PIECE, _ODD, np.uint64))
_DOWN = np.cumprod(np.full(_PIECE, pow(_ODD, -1, 1 << 64), np.uint64))
_VALUE = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
#: Bytes by class: 0 white space, 1 letters, digits and all beyond ASCII, 2 the rest.
_CLASS = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_BLOCK_BITS = 10
#: Words whose neighbours are counted at once.
_FLUSH = 1 << 18
#: Words whose vectors are held at once while a text is pooled.
_POOL = 1 << 15
_SALTS = 16


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text cut into pieces of at most 64 KB, at white space where there is any."""
    at = 0
    while len(raw) - at > _PIECE:
        space = np.flatnonzero(_CLASS[np.frombuffer(raw, np.uint8, _PIECE, at)] == 0)
        end = at + (int(space[-1]) + 1 if len(space) else _PIECE)
        yield raw[at:end]
        at = end
    if at < len(raw):
        yield raw[at:]


def word_codes(raw: bytes, bits: int) -> np.ndarray:
    """The hashed words of a whole UTF-8 text in order: runs of letters and digits, and runs of other signs; case counts. A run that goes
    on for 64 KB without white space is cut there."""
    out = [np.empty(0, np.int32)]
    for piece in _pieces(raw):
        b = np.frombuffer(piece, np.uint8)
        kind = _CLASS[b]
        start = np.flatnonzero(np.diff(kind, prepend=np.uint8(3)))
        end = np.append(start[1:], len(b))
        word = kind[start] > 0
        start, end = start[word], end[word]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * _UP[: len(b)], out=sums[1:])
        h = (sums[end] - sums[start]) * _DOWN[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((h ^ (h >> np.uint64(27))) * np.uint64(_ODD) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out)


def index_vectors(bits: int, dims: int, signs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's random vector; the row after the last stands between texts and is empty."""
    rng = np.random.default_rng(seed)
    places = rng.integers(0, dims, ((1 << bits) + 1, signs))
    values = rng.choice([-1.0, 1.0], places.shape)
    values[-1] = 0
    return places, values


def add_neighbours(sums: np.ndarray, codes: np.ndarray, dims: int, window: int, places: np.ndarray, values: np.ndarray) -> None:
    """Adds to each word's row of the flat ``sums`` the random vectors of the words up to ``window`` places before and after it."""
    for gap in range(1, window + 1):
        for word, other in ((codes[:-gap], codes[gap:]), (codes[gap:], codes[:-gap])):
            for i in range(places.shape[1]):
                sums += np.bincount(word * dims + places[other, i], values[other, i], len(sums))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks (k, data) that come sorted by k; holds one."""
    now, total = None, None
    one = lambda: pa.RecordBatch.from_pydict({"k": pa.array([now], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = np.frombuffer(data.as_buffer(), np.int64)
            if k != now:
                if now is not None:
                    yield one()
                now, total = k, own.copy()
            else:
                total += own
    if now is not None:
        yield one()


def word_vectors(docs: DataFrame, bits: int = 14, dims: int = 16, window: int = 2, signs: int = 4, seed: int = 11) -> np.ndarray:
    """Unit vectors (2 ** bits rows of ``dims``) learnt from all texts of ``docs``; rows that no word has are zero. Words of one hash share a row.
    Null and empty texts add nothing. The result is at most 2 ** bits x dims x 4 bytes (1 MB by default) whatever the corpus."""
    bounded_batches(docs.sparkSession)
    rows = 1 << bits
    block = min(rows, 1 << _BLOCK_BITS) * dims

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("quality")
        places, values = index_vectors(bits, dims, signs, seed)
        sums, held, n = np.zeros((rows + 1) * dims), [], 0
        between = np.full(window, rows, np.int32)
        for b in batches:
            for t in b.column(0):
                codes = word_codes(bytes(t.as_buffer() or b""), bits)
                held += [codes, between]
                n += len(codes)
                if n > _FLUSH:
                    add_neighbours(sums, np.concatenate(held), dims, window, places, values)
                    held, n = [], 0
        if n:
            add_neighbours(sums, np.concatenate(held), dims, window, places, values)
        found = sums[: rows * dims].astype(np.int64).reshape(-1, block)
        kept = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_pydict({"k": pa.array(kept, pa.int32()), "data": pa.array([found[k].tobytes() for k in kept], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "k int, data binary").withColumn("s", F.spark_partition_id() % _SALTS)
    some = counted.repartition("k", "s").sortWithinPartitions("k").select("k", "data").mapInArrow(_merge, "k int, data binary")
    merged = some.repartition("k").sortWithinPartitions("k").mapInArrow(_merge, "k int, data binary").collect()  # the matrix, of fixed size
    total = np.zeros((rows * dims // block, block))
    for r in merged:
        total[r.k] = np.frombuffer(r.data, np.int64)
    total = total.reshape(rows, dims)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(size > 0, size, 1)).astype(np.float32)


def pool(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Adds ``pooled`` (array of floats) to ``docs`` from the whole text alone: mean vector, mean product with the next word's, log of 1 + words.
    All zeros where a text is null or has no word. A column of that name is replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, bits, dims = spark.sparkContext.broadcast(vectors), len(vectors).bit_length() - 1, vectors.shape[1]
    plain = docs.drop("pooled")
    at, width = plain.columns.index("text"), 2 * dims + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("quality")
        table = shared.value
        for b in batches:
            out = np.zeros((b.num_rows, width), np.float32)
            for i, t in enumerate(b.column(at)):
                codes = word_codes(bytes(t.as_buffer() or b""), bits)
                total = np.zeros(2 * dims)
                for k in range(0, len(codes), _POOL):
                    v = table[codes[k : k + _POOL + 1]]  # one word more, for the last pair
                    total[:dims] += v[:_POOL].sum(axis=0, dtype=float)
                    total[dims:] += np.einsum("ij,ij->j", v[1:], v[:-1], dtype=float)
                out[i, :-1], out[i, -1] = total / max(1, len(codes)), np.log1p(len(codes))
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "pooled"])

    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField("pooled", T.ArrayType(T.FloatType()))]))


@dataclass
class Network:
    """tanh layer and logistic output over standardised inputs; logits are divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean log loss with ``decay`` / 2 times the squared weights."""
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    off = (1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -35, 35))) - y) / len(y)
    back = np.outer(off, v) * (1 - hidden * hidden)
    return [x.T @ back + decay * w, back.sum(axis=0), hidden.T @ off + decay * v, np.array([off.sum()])]


def fit(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rate: float, decay: float, seed: int) -> Network:
    """Adam over batches of 64 rows in a new order each epoch."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, d = (x - mean) / scale, x.shape[1]
    layers = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for k in range(0, len(z), 64):
            rows, step = order[k : k + 64], step + 1
            for i, g in enumerate(gradients(layers, z[rows], y[rows], decay)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, layers)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/8 to 8 of least log loss, by halving the bracket of its logarithm; the loss is convex in 1 / temperature."""
    slope = lambda t: float(np.mean((1 / (1 + np.exp(-np.clip(logits * t, -35, 35))) - y) * logits))
    lo, hi = -np.log(8), np.log(8)
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(np.exp(mid)) < 0 else (lo, mid)
    return float(np.exp(-(lo + hi) / 2))


def train(pooled: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> Network | None:
    """A network fitted to the rows of ``labels`` (doc_id, label 0/1) that are not held out and have a label and a row in ``pooled``: at most
    ``max_rows`` labels, those of smallest id hash. Four fifths are learnt from, the rest sets the temperature (1 where there is none of
    either label in it). Rows with a doc_id of several documents or labels are learnt from each. None without any such row."""
    sample = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    rows = pooled.select("doc_id", "pooled").join(F.broadcast(sample), "doc_id")  # at most max_rows rows of two numbers
    found = rows.select("y", "pooled").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "pooled").limit(max_rows).toPandas()  # a bounded sample of short rows
    if found.empty:
        return None
    x, y = np.stack(found["pooled"].to_numpy()).astype(float), found["y"].to_numpy(float)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return fit(x, y, hidden, epochs, rate, decay, seed)
    model = fit(x[~aside], y[~aside], hidden, epochs, rate, decay, seed)
    model.temperature = best_temperature(model.logits(x[aside]), y[aside])
    return model


def score(pooled: DataFrame, model: Network | None) -> DataFrame:
    """Adds ``score`` (0 to 1) to rows of ``pool``; 0.5 without a model. A column of that name is replaced."""
    plain = pooled.drop("score")
    if model is None:
        return plain.withColumn("score", F.lit(0.5))
    at, width = plain.columns.index("pooled"), len(model.mean)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(at).flatten()).reshape(-1, width).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, "score"])

    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
