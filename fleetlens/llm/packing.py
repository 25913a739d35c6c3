"""Bounded-space online best-fit packing of tokenised documents into sequences of at most ``seq_len`` ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .tokens import token_ids


class BestFit:
    """Open bins by free space: bit f of ``bits`` is set while some open bin has f places left.

    ``put(n)`` gives (bin, offset): the open bin with the least free space of n or more, else a new one. A bin without
    free space closes at once; when more than ``open_bins`` are open, the fullest closes.
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _open(self, b: int, free: int) -> None:
        self.at.setdefault(free, []).append(b)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def put(self, n: int) -> tuple[int, int]:
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.made, self.size
            self.made += 1
        if free > n:
            self._open(b, free - n)
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.size - free

    def left(self) -> dict[int, int]:
        """The bins that are still open, with their free space."""
        return {b: free for free, bins in self.at.items() for b in bins}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, free int"


def _cut(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, open_bins: int, buffer: int, plain: bool) -> DataFrame:
    """Pieces in bins of their own partition; free: places left in a bin that was open at the partition's end, else -1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fit, first = token_ids(tokenizer, plain), BestFit(seq_len, open_bins), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def place() -> None:
            waiting.sort(key=lambda x: -x[3])  # long pieces first: short ones fill what they leave
            rows.extend((*x, *fit.put(x[3])) for x in waiting)
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(tok.encode(text.as_py()), tok.dtype), np.array([end_id], tok.dtype))
                for k, start in enumerate(range(0, len(ids), seq_len)):
                    part = ids[start : start + seq_len]
                    waiting.append((doc_id, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                if len(waiting) >= buffer:
                    place()
        place()
        left = fit.left()
        for at in range(0, len(rows), 1 << 16):
            columns = [list(x) for x in zip(*rows[at : at + (1 << 16)], strict=True)]
            bins = columns[5]
            columns[5] = [first + b for b in bins]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns.append([left.get(b, -1) for b in bins])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "free"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


def _merge(left: DataFrame, seq_len: int, open_bins: int, tasks: int) -> DataFrame:
    """Packs partly filled bins (bin, used) into one another: bin, into, shift."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, own = BestFit(seq_len, open_bins), (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            put = [fit.put(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own + b for b, _ in put], pa.int64()), pa.array([s for _, s in put], pa.int64())], names=["bin", "into", "shift"])

    return left.repartition(tasks, "bin").sortWithinPartitions(F.desc("used"), "bin").mapInArrow(merge, "bin long, into long, shift long")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0, open_bins: int = 1024, buffer: int = 4096, tasks_a_merge: int = 16, plain: bool = False) -> DataFrame:
    """Packs the documents (doc_id long, text string; further columns are ignored) into sequences.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and gives
    the end id alone; only a document of more than ``seq_len`` ids is cut; repeated rows are packed each; an empty table
    gives no rows. Each partition packs its own stream in a fixed space of ``open_bins`` bins,
    the pieces of every ``buffer`` or so in order of length, the longest first. The bins that it leaves
    partly filled are packed once more, those of about ``tasks_a_merge`` partitions in one task, so that the partly
    filled rest does not grow with the number of partitions. Strings of special tokens in a text give those tokens, unless ``plain``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = stored(_cut(docs, tokenizer, seq_len, end_id, open_bins, buffer, plain), "pieces")
    left = pieces.filter("free > 0").groupBy("bin").agg(F.sum("length").alias("used"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // tasks_a_merge)
    moved = _merge(left, seq_len, open_bins, tasks)
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
