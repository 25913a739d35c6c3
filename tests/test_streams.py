"""Stateful streams: restarts from the checkpoint, timers, retries, and batches that are run again after a crash."""

import random
import time

import pytest
from fleetlens.sources.snapshots import SnapshotTable
from fleetlens.streaming import streams as st
from pyspark.sql import functions as F

BASE = 1_700_000_000


def add(spark, folder, rows, schema):
    """One more file, and so one more micro-batch."""
    spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{folder}")


def stream(spark, folder, schema):
    kinds = spark.createDataFrame([], schema).withColumn("t", F.timestamp_seconds("t")).schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{folder}")


def run(frame, folder, rows=None):
    """Takes all that is there: into files, or into the list ``rows``, as the memory sink cannot be started again."""
    q = frame.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    if rows is None:
        q = q.format("parquet").option("path", f"{folder}/out").start()
    else:
        q = q.outputMode("update").foreachBatch(lambda batch, _: rows.extend(batch.collect())).start()
    assert q.awaitTermination(180)
    return q


def test_settled_over_restarts(spark, tmp_path):
    """A query that is stopped and started again goes on from what its paths were; a path settles once."""
    schema = "path string, t long, size long"
    random.seed(4)
    polls = [(p, BASE + 10 * i, random.choice([None, 1, 2, 3])) for i in range(30) for p in "abcd"]
    for k in range(3):
        add(spark, tmp_path / "in", polls[40 * k : 40 * k + 40], schema)
        run(st.settled_arrivals_stream(stream(spark, tmp_path / "in", schema)), tmp_path)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).select("path", "t", "size").collect())
    known = spark.createDataFrame([p for p in polls if p[2] is not None], schema).withColumn("t", F.timestamp_seconds("t"))
    assert got == sorted(st.settled_arrivals(known).select("path", "t", "size").collect()) and len(got) == 4


def test_settled_paths_are_forgotten(spark, tmp_path):
    schema = "path string, t long, size long"
    for rows in ([("a", BASE, 1), ("a", BASE + 1, 1)], [("b", BASE + 9000, 1)], [("b", BASE + 18_000, 2)], [("b", BASE + 27_000, 3)]):
        add(spark, tmp_path / "in", rows, schema)
    q = run(st.settled_arrivals_stream(stream(spark, tmp_path / "in", schema), "10 minutes"), tmp_path)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and state[-1] < state[0] + 4


def test_history_equals_its_batch_twin_over_restarts(spark, tmp_path):
    schema = "key string, t long, value double"
    random.seed(6)
    events = sorted((BASE + random.randrange(3000), random.choice("aab"), random.random()) for _ in range(400))
    last = {}
    for k in range(4):
        part = [(key, t, v) for t, key, v in events[100 * k : 100 * k + 100]]
        add(spark, tmp_path / "in", part, schema)
        rows = []
        run(st.bounded_history_stream(stream(spark, tmp_path / "in", schema), "10 minutes", 30, "1 hour"), tmp_path, rows)
        last |= {r.key: (r.n, r.full) for r in rows}
        whole = spark.createDataFrame([(key, t, v) for t, key, v in events[: 100 * k + 100]], schema)
        want = st.bounded_history(whole, "key", "t", 600, 30).groupBy("key").agg(F.count("*").alias("n"), F.max("full").alias("full")).collect()
        assert last == {r.key: (r.n, r.full) for r in want}


def test_stateful_streams_name_the_store_they_need(spark, tmp_path):
    schema, key = "path string, t long, size long", "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        add(spark, tmp_path / "in", [("a", BASE, 1)], schema)
        with pytest.raises(ValueError, match="RocksDB"):
            st.settled_arrivals_stream(stream(spark, tmp_path / "in", schema))
    finally:
        spark.conf.set(key, was)


BODY = 'noise @@J: {"w": %s, "at": "2024-01-01", "mean": %s} tail'
FILES = "path string, t long, body string"


def harvest(spark, folder, **more):
    tables = [SnapshotTable(spark, f"{folder}/{n}", "path", "t", buckets=2) for n in ("index", "aside")]
    verdict = F.when(F.col("mean") == 0, "BLACK FRAME")
    refusal = F.when(F.col("w").isNull(), "no width").when(F.col("at").isNull(), "no time")
    q = st.harvest_stream(stream(spark, f"{folder}/in", FILES), "@@J:", "w long, at string, mean double", verdict, refusal, *tables, "harvest", f"{folder}/cp", **more)
    return q, *tables


def test_harvest_judges_each_path_once(spark, tmp_path):
    add(spark, tmp_path / "in", [("a", BASE, BODY % (8, 3.5)), ("b", BASE, BODY % (8, 0)), ("c", BASE, BODY % ("null", 1)), ("d", BASE, "no marker")], FILES)
    add(spark, tmp_path / "in", [("a", BASE + 60, BODY % (9, 0)), ("e", BASE, BODY % (4, 2))], FILES)
    q, index, aside = harvest(spark, tmp_path, most=1)
    assert q.awaitTermination(180)
    assert sorted((r.path, r.w, r.tries) for r in index.read().collect()) == [("a", 8, 1), ("e", 4, 1)]
    assert sorted((r.path, r.status) for r in aside.read().collect()) == [("b", "BLACK FRAME"), ("c", "no width"), ("d", "not parsed")]


def test_harvest_reads_again_until_a_file_is_whole(spark, tmp_path):
    """Files whose metadata trail behind are read again by timer, also by a query started anew; one that never gets any is given up."""
    add(spark, tmp_path / "in", [("late", BASE, "still cop"), ("never", BASE, "nothing")], FILES)
    whole = tmp_path / "late.txt"

    def read(path, at=str(whole)):
        try:
            return open(at).read() if path == "late" else None
        except OSError:
            return None

    settings = {"read": read, "retry": "1 second", "most": 5, "every": "1 second"}
    q, index, aside = harvest(spark, tmp_path, **settings)
    time.sleep(8)
    q.stop()
    assert not index.versions() or index.read().count() == 0
    whole.write_text(BODY % (7, 1))
    q, index, aside = harvest(spark, tmp_path, **settings)
    for _ in range(90):
        time.sleep(1)
        if index.versions() and aside.versions() and index.read().count() and aside.read().count():
            break
    q.stop()
    got = index.read().first()
    assert (got.path, got.w) == ("late", 7) and got.tries > 1
    assert [(r.path, r.status, r.tries) for r in aside.read().collect()] == [("never", "not parsed", 5)]


def test_harvest_after_a_crash_between_its_commits(spark, tmp_path, monkeypatch):
    add(spark, tmp_path / "in", [("a", BASE, BODY % (8, 3.5)), ("b", BASE, BODY % (8, 0))], FILES)
    real, calls = SnapshotTable.upsert, []

    def crash(self, batch, source=None):
        calls.append(self.path)
        if self.path.endswith("aside"):
            raise RuntimeError("lost")
        return real(self, batch, source)

    monkeypatch.setattr(SnapshotTable, "upsert", crash)
    q, index, aside = harvest(spark, tmp_path)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(180)
    assert index.read().count() == 1 and not aside.versions()
    monkeypatch.undo()
    first = index.versions()
    q, index, aside = harvest(spark, tmp_path)
    assert q.awaitTermination(180)
    numbers = index._load(index.versions()[-1])["sources"]
    assert [r.path for r in index.read().collect()] == ["a"] and [r.path for r in aside.read().collect()] == ["b"]
    assert numbers == aside._load(aside.versions()[-1])["sources"] and index.versions()[: len(first)] == first
