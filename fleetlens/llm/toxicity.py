"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is trained on a bounded sample of labelled rows (``max_rows``, the rows of smallest id hash), whose features are hashed in
parallel first. Several L1 strengths at one learning rate are tried, a task each, and judged on a fifth of the sample; the best is fitted
to all of it. L1 leaves few weights, so they are broadcast as two short arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cache_of, stored, take_turn

_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE_WORDS = 150_000
_words: dict[str, int] = {}
cache_of("toxicity", lambda: _words.clear())


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(text: str, bits: int) -> np.ndarray:
    """Hashed presence features of a whole text: words, pairs of neighbours, pairs with one word between."""
    global _words
    words = _WORD.findall(text.lower())
    if len(_words) > _CACHE_WORDS:
        _words = {}
    known = _words
    try:
        codes = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        codes = [known[w] for w in words]
    h = (np.array(codes, np.uint64) + np.uint64(1)) * _A
    shift = np.uint64(64 - bits)
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * _B) >> shift
    parts = [mix(h)]
    for gap, salt in ((1, 3), (2, 5)):
        if len(h) > gap:
            parts.append(mix(h[:-gap] * np.uint64(salt) + (h[gap:] ^ _B)))
    return np.concatenate(parts).astype(np.uint32)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features of value 1; coordinate ``1 << bits`` is the intercept."""

    def __init__(self, bits: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def loss(self, at: np.ndarray, label: int) -> float:
        x = float(np.clip(self.weights(at).sum(), -35, 35))
        return float(np.log1p(np.exp(-x if label else x)))


def _pack(f: np.ndarray) -> bytes:
    """Sorted distinct features as gaps of two bytes; 65535 means that and more to come."""
    gap = np.diff(f.astype(np.int64), prepend=0)
    more = gap // 65535
    out = np.full(int(more.sum()) + len(gap), 65535, "<u2")
    out[np.cumsum(more + 1) - 1] = gap % 65535
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, "<u2")
    return np.cumsum(a, dtype=np.int64)[a != 65535].astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, l1: float, epochs: int, seed: int) -> Ftrl:
    """Passes over the rows (features, label), each in an order of its own drawn from the seed."""
    model, rng = Ftrl(bits, alpha=alpha, l1=l1), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    return model


#: (alpha, l1) that are tried; a stronger l1 leaves fewer weights, which suits all but a few rows.
SETTINGS = ((1.0, 0.5), (1.0, 2.0), (1.0, 4.0), (1.0, 8.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, bits: int = 20, epochs: int = 4, settings: tuple[tuple[float, float], ...] = SETTINGS, seed: int = 5) -> pd.DataFrame:
    """Non-zero weights (feature, weight); the intercept is feature ``1 << bits``.

    Learns from the rows of ``labels`` (doc_id, label 0/1) that are not held out and have a label, at most ``max_rows`` of
    them. Each of ``settings`` is fitted in a task of its own to four fifths of the rows and judged by its loss on the rest, all rows
    where there is no rest; the best, the first of equals, is fitted to all. Null texts are empty. Rows with a doc_id of
    several documents or labels are learnt from each. Without any such row the weights are empty, which scores every text 0.5.
    """
    bounded_batches(docs.sparkSession)
    sample = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        for b in batches:
            rows = [_pack(np.unique(features(t.as_py(), bits))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["o", "y", "f"])

    def of_setting(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[tuple[np.ndarray, int]]]]:
        """(setting, order, rows) of each setting that a task holds, one after the other."""
        now, order, rows = None, [], []
        for b in batches:
            for s, o, y, f in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and s != now:
                    yield now, order, rows
                    order, rows = [], []
                now = s
                order.append(o)
                rows.append((np.append(_unpack(f), np.uint32(1 << bits)), y))
        if rows:
            yield now, order, rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        for s, order, rows in of_setting(batches):
            aside = [r for o, r in zip(order, rows, strict=True) if o % 5 == 0]
            model = fit([r for o, r in zip(order, rows, strict=True) if o % 5], bits, *settings[s], epochs, seed) if aside else fit(rows, bits, *settings[s], epochs, seed)
            loss = sum(model.loss(*r) for r in aside or rows) / len(aside or rows)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([loss])], names=["s", "loss"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        for s, _, rows in of_setting(batches):
            w = fit(rows, bits, *settings[s], epochs, seed).weights(np.arange((1 << bits) + 1))
            kept = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w[kept])], names=["feature", "weight"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows rows of two numbers
    rows = joined.select(F.xxhash64("doc_id", "text").alias("o"), "y", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hashes = stored(rows.mapInArrow(hashed, "o long, y int, f binary"), "labelled")
    dealt = lambda s: hashes.select(F.explode(F.array(*map(F.lit, s))).alias("s"), "o", "y", "f").repartition(len(s), "s").sortWithinPartitions("s", "o", "y", "f")
    found = dealt(range(len(settings))).mapInArrow(judge, "s int, loss double").collect()
    if not found:
        return pd.DataFrame({"feature": np.empty(0, np.int64), "weight": np.empty(0)})
    best = min(found, key=lambda r: (r.loss, r.s)).s
    return dealt([best]).mapInArrow(learn, "feature long, weight double").toPandas()


def score(docs: DataFrame, weights: pd.DataFrame, bits: int = 20) -> DataFrame:
    """Adds ``score`` (0 to 1) to ``docs`` from the whole text alone; a null text counts as empty. A column of that name is
    replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((weights["feature"].to_numpy(np.int64), weights["weight"].to_numpy(float)))
    plain = docs.drop("score")
    at = plain.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        w = np.zeros((1 << bits) + 1)
        w[shared.value[0]] = shared.value[1]
        has = w != 0
        for b in batches:
            out = []
            for text in b.column(at):
                f = features(text.as_py() or "", bits)
                out.append(w[np.unique(f[has[f]])].sum() + w[1 << bits])
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
