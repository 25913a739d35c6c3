"""The driver tables in the shapes that the operators take, and the same shapes in SQL.

renders: orders; passes: the line items of an order, numbered by their unique key; series: the line items of a
supplier, where orders are too short; samples: events; pixels: embeddings as 8 x 8 rasters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, inputs, at_s (seconds), day, engine, state, ms, w."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("inputs"),
        F.floor(micros("o_orderdate") / 1_000_000).alias("at_s"),
        F.col("o_orderpriority").alias("engine"), F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("ms"), (F.col("o_custkey") % 7 + 1).alias("w"),
    )


RENDERS = """renders AS (SELECT o_orderkey AS file, o_custkey AS inputs, epoch_us(o_orderdate) // 1000000 AS at_s,
    o_orderpriority AS engine, o_orderstatus AS state, o_totalprice AS ms, o_custkey % 7 + 1 AS w FROM orders)"""


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """render, pass, ms, bytes, worker, flag, part."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("render"), F.row_number().over(own).cast("long").alias("pass"),
        F.col("l_extendedprice").alias("ms"), F.col("l_quantity").alias("bytes"), F.col("l_suppkey").alias("worker"),
        F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"),
    )


PASSES = """passes AS (SELECT l_orderkey AS render, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey) AS pass, l_extendedprice AS ms, l_quantity AS bytes, l_suppkey AS worker, l_returnflag AS flag,
    l_partkey AS part FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """render, pass (from 1), ms, bytes, flag, part: many passes each."""
    own = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("render"), F.row_number().over(own).cast("long").alias("pass"),
        F.col("l_extendedprice").alias("ms"), F.col("l_quantity").alias("bytes"), F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"),
    )


SERIES = """series AS (SELECT l_suppkey AS render, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
    l_linenumber, l_partkey) AS pass, l_extendedprice AS ms, l_quantity AS bytes, l_returnflag AS flag,
    l_partkey AS part FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, series, t (microseconds), kind, value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("series"), micros("ts").alias("t"), F.col("event_type").alias("kind"), "value"
    )


SAMPLES = "samples AS (SELECT event_id AS id, user_id AS series, epoch_us(ts) AS t, event_type AS kind, value FROM events)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, label, x, y, v: an 8 x 8 raster per vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), "label", F.posexplode("embedding").alias("p", "e")
    ).select("image", "label", (F.col("p") % 8).alias("x"), F.expr("p div 8").cast("int").alias("y"), F.col("e").cast("double").alias("v"))


PIXELS = """pixels AS (SELECT vec_id AS image, label, ((p - 1) % 8)::INT AS x, ((p - 1) // 8)::INT AS y, embedding[p]::DOUBLE AS v
    FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS p FROM embeddings))"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with q, an integer of 0 to 255."""
    return pixels(spark, sf_dir).withColumn("q", (F.floor(F.abs("v") * 255) % 256).cast("int"))


LEVELS = PIXELS + ", levels AS (SELECT *, (floor(abs(v) * 255)::BIGINT % 256)::INT AS q FROM pixels)"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, tier, id, width, length, area, and a place x, y made of the keys."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("tier"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.col("l_quantity").alias("width"), (F.col("l_extendedprice") / 100).alias("length"), (F.col("l_quantity") * F.col("l_extendedprice") / 100).alias("area"),
        (F.col("l_orderkey") * 7 % 499).cast("double").alias("x"), (F.col("l_partkey") * 13 % 503 / 2.0).alias("y"),
    )


COMPONENTS = """components AS (SELECT l_suppkey AS image, l_returnflag AS tier, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id,
    l_quantity AS width, l_extendedprice / 100 AS length, l_quantity * l_extendedprice / 100 AS area,
    (l_orderkey * 7 % 499)::DOUBLE AS x, (l_partkey * 13 % 503) / 2.0 AS y FROM lineitem)"""


#: CRC-32 in SQL: ``crc_table`` as a common table expression, and the sum of a list of bytes.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i)))"""


def crc_sql(numbers: str) -> str:
    return f"xor(list_reduce({numbers}::BIGINT[], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
