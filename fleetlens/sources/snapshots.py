"""A table of one row per key that is changed by snapshot commits: new files beside the old, then one pointer that only one writer can put."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop


class SnapshotTable:
    """``path`` holds ``data/<commit>/_bucket=<b>`` folders and ``versions/<n>.json``, which names for each bucket of keys the folder that holds
    it. A reader sees one version as a whole, old or new. A commit rewrites only the buckets that its keys fall into.

    Two writers at once: both prepare version n + 1, one of them puts it, and the other merges again with what the first has put. A
    writer that is lost leaves files that no version names, which ``vacuum`` removes. The pointer is put by a hard link on a local disk and by
    a rename elsewhere, so the file system must rename atomically and refuse to overwrite (HDFS does).
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _fs(self):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The numbers of all versions that are there, in order."""
        fs, at = self._fs(), self._at("versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int | None) -> dict:
        if version is None:
            return {"version": 0, "buckets": {}, "n": self.buckets, "schema": None, "sources": {}}
        stream = self._fs().open(self._at(f"versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, text: str) -> bool:
        """Puts a version if it is not there yet; the file appears with all its text or not at all."""
        fs, own = self._fs(), f"versions/.{uuid.uuid4().hex}"
        fs.mkdirs(self._at("versions"))
        out = fs.create(self._at(own), True)
        out.write(bytearray(text.encode()))
        out.close()
        url = urlparse(fs.makeQualified(self._at("versions")).toString())
        if url.scheme == "file":
            try:
                os.link(f"{url.path}/{own[9:]}", f"{url.path}/{version}.json")
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(self._at(own), False)
        done = bool(fs.rename(self._at(own), self._at(f"versions/{version}.json")))
        if not done:
            fs.delete(self._at(own), False)
        return done

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last. Later versions do not change what was read."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version if known else ''} in {self.path}")
        return self._rows(self._load(known[-1] if version is None else version), None)

    def _rows(self, state: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{p}" for b, p in state["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, source: tuple[str, int] | None = None) -> int:
        """Merges ``batch`` by key and returns the version that holds it: of each key the row of latest ``order`` stays, the batch's among equals.
        Columns that one side lacks are null. ``source`` (name, number) makes a commit idempotent: numbers of a source up to the last one
        committed change nothing. An empty batch gives a version too, so that its number counts as done."""
        bucket = lambda n: F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")
        while True:
            known = self.versions()
            state = self._load(known[-1] if known else None)
            if source is not None and state["sources"].get(source[0], -1) >= source[1]:
                return state["version"]
            rows = batch.withColumn("_new", F.lit(1))
            touched = sorted(r[0] for r in batch.select(bucket(state["n"])).distinct().collect())  # ``buckets`` numbers at most
            if state["schema"] is not None:
                rows = self._rows(state, touched).withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
            columns = [c for c in rows.columns if c != "_new"]
            latest = F.max_by(F.struct(*columns), F.struct(self.order, "_new")).alias("_row")  # an aggregate, so many rows of one key meet as one each task
            merged = rows.groupBy(F.col(self.key).alias("_key")).agg(latest).select("_row.*")
            commit = f"data/{uuid.uuid4().hex}"
            merged.withColumn("_bucket", bucket(state["n"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{commit}")
            buckets = state["buckets"] | {str(b): f"{commit}/_bucket={b}" for b in touched}
            sources = state["sources"] | ({source[0]: source[1]} if source is not None else {})
            new = {"version": state["version"] + 1, "buckets": buckets, "n": state["n"], "schema": merged.schema.jsonValue(), "sources": sources}
            if self._put(new["version"], json.dumps(new)):
                return new["version"]
            drop(self.spark, f"{self.path}/{commit}")

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the last ``keep`` and the data that those do not name. Not for use while others write."""
        fs, known = self._fs(), self.versions()
        named = {p.split("/")[1] for v in known[-keep:] for p in self._load(v)["buckets"].values()}
        for v in known[:-keep]:
            fs.delete(self._at(f"versions/{v}.json"), False)
        if fs.exists(self._at("data")):
            for s in fs.listStatus(self._at("data")):
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)
