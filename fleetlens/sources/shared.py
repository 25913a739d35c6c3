"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master a temporary folder where it is unset, and an error elsewhere, as executors could
    not read it. The session's checkpoints go there too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="fleetlens-")
        base = _own[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/fleetlens-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to that folder and read back: what was dealt out stays as it is, whichever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def opened(spark: SparkSession, path: str) -> tuple[str | None, str]:
    """The URI of the file system of ``path`` and its path in it, once Arrow opens that file system; without URI where it does not."""
    import pyarrow.fs as pafs

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    uri, at = f"{p.getScheme()}://{p.getAuthority() or ''}/", p.getPath()
    try:
        if p.getScheme() != "file":
            pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None, at
    return uri, at


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders that are read here are listed by some tasks a core, not by a task each up to 10,000: such a task takes up some 30 ms besides its folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replaced(spark: SparkSession, made: str, path: str) -> None:
    """The folder ``made``, which tasks filled by way of its _temporary, takes the place of ``path``, with the mark that it is whole."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(of(made))
    fs.delete(of(made, "_temporary"), True)
    fs.create(of(made, "_SUCCESS")).close()
    fs.delete(of(path), True)
    if not fs.rename(of(made), of(path)):
        raise OSError(f"{made} could not be moved to {path}")


def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session's JVM may be gone already
            return
