"""Connected components over an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch


def _star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbourhood, then each node and its smaller neighbours do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    large = large.filter("a <> b").distinct()
    # from here on b < a
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a long, b long), component being the least node reachable.

    Loops and repeated edges do no harm; no edges give no rows. Every round is written to the shared folder and counted
    against the one before; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    before, path = None, None
    for _ in range(most_rounds):
        new = scratch(spark, "edges")
        _star(now).write.parquet(new)
        if path:
            drop(spark, path)
        path = new
        now = spark.read.schema("a long, b long").parquet(path)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.sum("b").alias("t")).first()
        if state == before or state.n == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge leads from a node to its component's least node
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
