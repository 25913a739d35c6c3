"""Each stage of the pipeline against brute force on its own input."""

import os
from collections import Counter

import corpus_pipeline as cp
import pytest
from fleetlens.llm.common import stored
from fleetlens.llm.decontaminate import normal

from .test_near_dup import brute as near_brute
from .test_suffix_dedup import brute as cut_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        steps.append(docs)
    all_, clean, single, cut, kept = [{r.doc_id: r.text for r in d.collect()} for d in steps]

    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic == 1}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    right = sum((d in clean) == (d not in toxic) for d in labelled)
    assert right >= 0.9 * len(labelled) and set(clean) < set(all_)

    assert set(single) == {d for d, _, _, keep in near_brute(sorted(clean.items())) if keep}

    want = {d: b.decode("utf-8", "ignore") for d, _, _, _, b in cut_brute(sorted(single.items()), cp.REPEAT_BYTES)}
    assert {d: t or "" for d, t in cut.items()} == want

    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    holds = {d for d, t in cut.items() if any(i and i in normal(t or "") for i in items)}
    assert not holds & set(kept)

    pieces = cp.pack(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(kept.keys())
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_repeated_rows_leave_one_text(spark):
    long, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    rows = [(1, long, "a"), (1, long, "b"), (1, long.upper(), "a"), (1, other, "a"), (2, other + " end", None), (3, None, "a"), (3, None, "a"), (3, " ", "a"), (4, "x y", "a"), (None, "z", "a"), (None, "z", "a")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "test")
    single = stored(cp.drop_near_duplicates(spark, docs, SF), "test")
    assert single.columns == docs.columns
    want = [(1, long.upper(), "a"), (1, other, "a"), (3, None, "a"), (3, None, "a"), (3, " ", "a"), (4, "x y", "a"), (None, "z", "a"), (None, "z", "a")]
    assert Counter(map(tuple, single.collect())) == Counter(want)
    assert Counter(map(tuple, cp.cut_repeats(spark, single, SF).collect())) == Counter(want)


def test_toxicity_keeps_all_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == 2


def test_run_is_the_stages(spark):
    assert cp.run(spark, SF).count() > 0 and len(cp.STAGES) == 5
