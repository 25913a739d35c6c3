"""Tiles as a data source: partitions planned from a directory's row groups, filters taken before anything is read.

    spark.dataSource.register(TileSource)
    spark.read.format("tiles").option("directory", uri).load().filter("codec = 8 and idx between 10 and 90")

The directory is a Parquet data set of (path, idx, offset, length, codec). A partition is one row group of it, so planning reads footers
only and its size does not depend on the tiles. The session needs ``spark.sql.python.filterPushdown.enabled``: comparisons of idx, offset, length
and codec with a value are taken by the source, row groups whose statistics exclude them are not planned, and no tile that they exclude is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The two numbers of deflate among a tile's codecs.
DEFLATE = (8, 32946)
SCHEMA = "path string, idx long, offset long, length long, codec int, px binary, reason string"
_NUMBERS = ("idx", "offset", "length", "codec")
#: Bytes of tiles of a batch.
_BATCH_BYTES = 16 << 20


def _open(uri: str):  # noqa: ANN202
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass
class RowGroup(InputPartition):
    """A row group of a file of the directory."""

    path: str
    number: int


def _holds(f: Filter, low: object, high: object) -> bool:
    """Whether a value from low to high can pass."""
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value)
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high > f.value or isinstance(f, GreaterThanOrEqual) and high == f.value
    return low < f.value or isinstance(f, LessThanOrEqual) and low == f.value


class TileReader(DataSourceReader):
    def __init__(self, directory: str):
        self.directory, self.taken = directory, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _NUMBERS and all(isinstance(v, int) for v in values):
                self.taken.append(f)
            else:
                yield f

    def partitions(self) -> list[RowGroup]:
        import pyarrow.dataset as ds

        fs, at = _open(self.directory)
        out = []
        for piece in ds.dataset(at, filesystem=fs, format="parquet").get_fragments():
            for group in piece.row_groups:
                stats = group.statistics or {}
                ends = [(f, stats[f.attribute[0]]) for f in self.taken if f.attribute[0] in stats]
                if all(_holds(f, s["min"], s["max"]) for f, s in ends):
                    out.append(RowGroup(piece.path, group.id))
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None:  # no row group is left
            return
        fs, _ = _open(self.directory)
        rows = pq.ParquetFile(fs.open_input_file(partition.path)).read_row_group(partition.number, columns=["path", *_NUMBERS])
        keep = [all(r[f.attribute[0]] is not None and _holds(f, r[f.attribute[0]], r[f.attribute[0]]) for f in self.taken) for r in rows.select(_NUMBERS).to_pylist()]
        rows = sorted(rows.filter(pa.array(keep, pa.bool_())).to_pylist(), key=lambda r: (r["path"] or "", r["offset"] or 0))
        kinds = [("path", pa.string()), *((c, pa.int32() if c == "codec" else pa.int64()) for c in _NUMBERS), ("px", pa.binary()), ("reason", pa.string())]
        held, size, now, file = [], 0, None, None
        try:
            for r in rows:
                px = reason = None
                if r["codec"] not in DEFLATE:
                    reason = f"codec {r['codec']}"
                else:
                    try:
                        if r["path"] != now:
                            if file is not None:
                                file.close()
                            own, at = _open(r["path"])
                            now, file = r["path"], own.open_input_file(at)
                        file.seek(r["offset"])
                        px = zlib.decompress(file.read(r["length"]))
                    except (zlib.error, OSError, TypeError, AttributeError) as e:
                        reason = type(e).__name__
                held.append({**r, "px": px, "reason": reason})
                size += len(px or b"") + 100
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))
                    held, size = [], 0
        finally:
            if file is not None:
                file.close()
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))


class TileSource(DataSource):
    """Format ``tiles``: (path, idx, offset, length, codec, px, reason). Deflated tiles come inflated as px; tiles of another codec or that do not
    inflate have a reason instead."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options["directory"])
