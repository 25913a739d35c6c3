"""Token ids in Arrow IPC files of fixed-size lists: equal-length sequences and masks with zero-copy random access.

A data set is a folder of shards and a manifest. Shard k holds the documents of one doc_id range in ascending order,
their ids one after the other, cut into sequences of ``seq_len``; the mask is false on the padding at a shard's end.
Every record batch holds ``batch_rows`` sequences, so sequence s of a shard lies in batch s // batch_rows at a place
known without reading anything else. ``<shard>.docs.arrow`` has (doc_id, start, n_tokens) with starts in the shard;
the manifest adds the ids before each shard. No document crosses a shard.
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import token_ids

#: Sequences in a record batch; the last batch of a shard may be shorter.
BATCH_ROWS = 64


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def shard_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), seq_len), nullable=False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len), nullable=False),
    ])


class _ShardWriter:
    """Writes one shard under a temporary name and moves it into place, so that a task that runs again does no harm."""

    def __init__(self, out: str, shard: int, dtype: np.dtype, seq_len: int):
        self.fs, self.folder = _open(out)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.dtype, self.seq_len = f"shard-{shard:06d}", dtype, seq_len
        self.temp = f".{self.name}-{TaskContext.get().taskAttemptId()}"
        self.schema = shard_schema(dtype, seq_len)
        self.sink = self.fs.open_output_stream(posixpath.join(self.folder, self.temp))
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.total = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.total, n))
        self.parts.append(ids)
        self.held += n
        self.total += n
        if self.held >= BATCH_ROWS * self.seq_len:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        block = BATCH_ROWS * self.seq_len
        whole = len(ids) if last else len(ids) // block * block
        rest = ids[whole:]
        self.parts, self.held = ([rest.tobytes()] if len(rest) else []), len(rest)
        for at in range(0, whole, block):
            part = ids[at : min(at + block, whole)]
            rows = -(-len(part) // self.seq_len)
            full = np.zeros(rows * self.seq_len, self.dtype)
            full[: len(part)] = part
            mask = np.arange(rows * self.seq_len) < len(part)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema, strict=True)]
            self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        self._flush(last=True)
        self.file.close()
        self.sink.close()
        ids, starts, counts = (list(x) for x in zip(*self.docs, strict=True)) if self.docs else ([], [], [])
        docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with self.fs.open_output_stream(posixpath.join(self.folder, f"{self.temp}.docs")) as sink, pa.ipc.new_file(sink, docs.schema) as file:
            file.write_table(docs, max_chunksize=1 << 16)
        self.fs.move(posixpath.join(self.folder, f"{self.temp}.docs"), posixpath.join(self.folder, f"{self.name}.docs.arrow"))
        self.fs.move(posixpath.join(self.folder, self.temp), posixpath.join(self.folder, f"{self.name}.arrow"))
        return self.name, len(self.docs), self.total


def write_token_files(docs: DataFrame, out: str, tokenizer: str, seq_len: int = 2048, end_id: int = 0, shards: int | None = None, plain: bool = False) -> None:
    """Tokenises ``docs`` (doc_id long, text string; further columns are ignored) into a data set at the URI ``out``.

    Documents are range-partitioned and sorted by doc_id (rows of one doc_id by text; a null doc_id comes first); a null
    text counts as empty and gives the end id alone. ``shards`` defaults to the session's shuffle partitions, whose
    number is to be set so that one holds about 64 MB of text. An empty table gives a manifest without shards. Strings of
    special tokens in a text give those tokens, unless ``plain``. The URI must be one that both Spark and Arrow open (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, tok, end = None, token_ids(tokenizer, plain), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    writer = _ShardWriter(out, TaskContext.get().partitionId(), tok.dtype, seq_len)
                    end = np.array([end_id], tok.dtype).tobytes()
                writer.add(doc_id, tok.encode(text.as_py()) + end)
        if writer is not None:
            name, rows, tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [rows], "n_tokens": [tokens]})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard string, n_docs long, n_tokens long")
        .collect()  # a line for each file, as in any commit
    )
    base, lines = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        lines.append(json.dumps({"shard": r.shard, "base": base, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "seq_len": seq_len}))
        base += r.n_tokens
    fs, folder = _open(out)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(posixpath.join(folder, "manifest.jsonl")) as sink:
        sink.write("".join(f"{x}\n" for x in lines).encode())


class TokenFile:
    """Random access to one shard: ``sequence(s)`` and ``mask(s)`` are views of the mapped file where it is local."""

    def __init__(self, out: str, shard: str):
        fs, folder = _open(out)
        path = posixpath.join(folder, f"{shard}.arrow")
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size

    def batch_ids(self, b: int) -> np.ndarray:
        ids = self.file.get_batch(b).column(0)
        return ids.values.to_numpy(zero_copy_only=True)[ids.offset * self.seq_len : (ids.offset + len(ids)) * self.seq_len]

    def sequence(self, s: int) -> np.ndarray:
        at = s % BATCH_ROWS * self.seq_len
        return self.batch_ids(s // BATCH_ROWS)[at : at + self.seq_len]

    def mask(self, s: int) -> pa.Array:
        return self.file.get_batch(s // BATCH_ROWS).column(1)[s % BATCH_ROWS].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard."""
        block, parts = BATCH_ROWS * self.seq_len, []
        while n > 0:
            part = self.batch_ids(start // block)[start % block : start % block + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "<u4")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """The documents of a data set, from its files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, folder = _open(out)
                tokens = TokenFile(out, shard)
                with fs.open_input_file(posixpath.join(folder, f"{shard}.docs.arrow")) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crc = [zlib.crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.schema("shard string, base long").json(f"{out}/manifest.jsonl")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
