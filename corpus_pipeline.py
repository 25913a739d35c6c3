"""The corpus pipeline over ``documents``: toxicity, near-duplicates, suffix-sort dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is a plain Parquet table. All but the last
return the columns of ``docs``. Rows with a null doc_id pass the near-duplicate stage; null texts stay null and are empty to
every stage; rows of one doc_id share what is decided by id, and the near-duplicate stage keeps one of those with the same
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import decontaminate, near_dup, packing, suffix_dedup, toxicity
from fleetlens.llm.common import stored, take_turn
from fleetlens.llm.tokens import tokenizer_path

#: Bytes of a repeated string that is removed: less than what fifty words take.
REPEAT_BYTES = 240

#: No SQL can express the trained filter or the approximate candidates; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a classifier trained on the labelled rows scores 0.5 or more; none where no label
    could be learnt from."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if weights.empty:
        return docs
    scored = toxicity.score(docs, weights)
    return scored.filter("score < 0.5").select(*docs.columns)


def _one_of_each_set(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and set of shingles, the one of least text; rows without a doc_id or shingles stay."""
    at = docs.columns.index("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("words")
        for b in batches:
            found = (near_dup.shingles(bytes(t.as_buffer() or b""), 5) for t in b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())], names=[*b.schema.names, "_set"])

    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again"))
    repeated = stored(repeated, "repeated-ids")  # of known size, which is mostly none
    if repeated.isEmpty():
        return docs
    again = docs["doc_id"] == repeated["_again"]
    rows = docs.join(repeated, again, "left_semi").mapInArrow(sets, T.StructType([*docs.schema.fields, T.StructField("_set", T.BinaryType())]))
    order = Window.partitionBy("doc_id", "_set").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    first = rows.filter("_set is not null").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return docs.join(repeated, again, "left_anti").unionByName(rows.filter("_set is null").select(*docs.columns)).unionByName(first.select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every group of near-duplicates (five-word shingles, 0.8), and one of its rows with the same shingles."""
    gone = near_dup.near_duplicates(docs, percent=80, stable=True).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    single = _one_of_each_set(docs)
    return single.join(gone, single["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte string of ``REPEAT_BYTES`` that occurs more than once out of the texts; characters cut in half go
    too, and n_chars follows the new text."""
    out = suffix_dedup.remove_repeated_bytes(docs, REPEAT_BYTES, stable=True, as_text=True)
    hit = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(hit, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row per piece."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("suffix dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
