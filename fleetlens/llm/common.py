"""Helpers shared by the corpus operators: the shared folder, plain reads and word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import drop, scratch, shared_dir  # noqa: F401

#: A word of the corpus contracts: a run without the six ASCII white-space characters.
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows of an Arrow batch: the JVM and the worker each hold one, and texts may be long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to ``BATCH_ROWS`` where it has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: In a worker process: what empties each operator's cache, and whose turn it is.
_caches: dict[str, Callable[[], None]] = {}
_turn = ""


def cache_of(name: str, empty: Callable[[], None]) -> None:
    _caches[name] = empty


def take_turn(name: str) -> None:
    """Called where a task begins: a worker process outlives its stage, so the caches of other operators are emptied and their memory is
    given back."""
    global _turn
    if _turn == name:
        return
    _turn = name
    for other, empty in _caches.items():
        if other != name:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
