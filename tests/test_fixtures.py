"""Known answers: every verdict comes with an input that flips it, and absence stays apart from zero."""

import pytest
from fleetlens.functions import scalars as sc
from fleetlens.operators import fleet, hardware, joins, raster, sequence, stats
from fleetlens.sources.files import last_object
from fleetlens.sources.text import scan_lines
from fleetlens.operators.text import resolve
from pyspark.sql import functions as F

VERDICTS = [
    (("wood", 23.33, 0.0, 666, 70, 232, 8050), "NOTHING LIT"),
    (("stone", 0.0, 0.0, 666, 70, 0, 0), "BLACK FRAME"),
    (("stone", 1.29, 0.94, 1224, 361, 0, 0), None),
    (("glass", 129.63, 100.0, 14, 0, 0, 0), None),
    (("stone", 229.52, 100.0, 4, 0, 0, 0), "EMPTY STONE"),
    ((None, 129.63, 100.0, 14, 0, 0, 0), None),
    (("stone", None, None, 4, 1, 0, 0), None),
]


def test_render_verdicts(spark):
    df = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(VERDICTS)], "i int, material string, mean double, lit40 double, marks int, lines int, cracks int, specks int")
    v = sc.render_verdict(*[F.col(c) for c in ("mean", "lit40", "material", "marks", "lines", "cracks", "specks")])
    assert [r.v for r in df.select("i", v.alias("v")).orderBy("i").collect()] == [want for _, want in VERDICTS]


def test_builds_compare_by_number(spark):
    rows = [("1.10", "1.9", True), ("1.9", "1.10", False), ("2", "2.0.0", True), ("1.2.3", "1.2.4", False), ("x", "0", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", sc.build_gte(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect())


def test_signature_moves_with_fields_and_only_with_them(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (1, 2.5, "b"), (1, 2.6, "a"), (None, None, "a")], "x int, y double, other string")
    s = [r.s for r in df.select(sc.state_signature(F.col("x"), F.col("y")).alias("s")).collect()]
    assert s[0] == s[1] != s[2] and s[3] is None


def test_carry_flips_with_the_bytes(spark):
    def arms(slow_bytes):
        return [(1, i, 100.0 if i % 100 else 300.0, 10.0 if i % 100 else slow_bytes) for i in range(1, 4001)]

    carry = lambda b: fleet.slow_tile_carry(spark.createDataFrame(arms(b), "render int, pass int, ms double, bytes double")).collect()[0].carry
    assert carry(30.0) == 1.0 and carry(10.0) == 0.0


def test_resume_and_stall(spark):
    renders = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0), (4, 0.0)], "file int, ms double")
    passes = spark.createDataFrame([(1, 120.0), (2, 50.0), (2, 20.0), (3, 101.0), (4, 5.0)], "render int, ms double")
    got = {r.file: (r.verdict, r.off) for r in fleet.resume_stall(renders, passes).collect()}
    assert got == {1: ("resumed", True), 2: ("stalled", True), 3: ("whole", False), 4: (None, None)}


@pytest.mark.parametrize(("q", "rule", "want"), [(0.5, "upper", 3), (0.9, "upper", 5), (0.1, "nearest", 1), (0.5, "nearest", 3), (0.95, "nearest", 5)])
def test_ranks(spark, q, rule, want):
    df = spark.createDataFrame([("a", i) for i in (5, 3, 1, 2, 4)] + [("b", None)], "k string, v int")
    assert [tuple(r) for r in stats.exact_rank(df, ["k"], "v", q, rule).collect()] == [("a", want)]
    assert [r.v for r in stats.exact_rank(df, [], "v", q, rule).collect()] == [want]


def test_pyramid_cases(spark):
    cases = {1: [0, 0, 1, 1], 2: [0, 0, 0, 1], 3: [3, 3, 4, 4]}
    rows = [(k, i % 2, i // 2, q, 255) for k, v in cases.items() for i, q in enumerate(v)] + [(4, 0, 0, 255, 255)] + [(4, i % 2, i // 2, 9, 0) for i in (1, 2, 3)] + [(5, 0, 0, 9, 0)]
    got = {r.image: (r.q, r.a) for r in raster.pyramid_level(spark.createDataFrame(rows, "image int, x int, y int, q int, a int")).collect()}
    assert got == {1: (1, 255), 2: (0, 255), 3: (4, 255), 4: (255, 64), 5: (0, 0)}


def test_seam_step_returns_the_step(spark):
    for step in (0.0, 5.0):
        rows = [(1, x, 0.3 * x + (x * 7 % 5) * 0.01 + (step if x >= 64 else 0.0)) for x in range(128)]
        got = {r.j: r.step for r in raster.seam_step(spark.createDataFrame(rows, "k int, x long, v double"), "k", 64, 16).collect()}
        assert abs(got[64] - step) < 0.05 and abs(got[32]) < 0.05


def test_longest_run(spark):
    hot = [1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", i, h) for i, h in enumerate(hot)] + [("b", 0, 1), ("c", 0, 0)], "k string, seq int, h int")
    got = {(r.k, r.seq): r.phase for r in sequence.longest_run(df, "k", "seq", F.col("h") == 1, 2).collect()}
    assert [got["a", i] for i in (0, 4, 5, 14)] == ["loaded", "loaded", "post", "post"] and got["b", 0] is None and got["c", 0] is None


def test_nearest_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, 10), (2, 100), (3, None)], "id int, t long")
    right = spark.createDataFrame([(8, 1.0), (12, 2.0), (92, 3.0), (109, 4.0)], "rt long, v double")
    got = {r.id: (r.near_t, r.near_value) for r in joins.nearest_in_time(left, right, 8, "v").collect()}
    assert got == {1: (8, 1.0), 2: (92, 3.0), 3: (None, None)}


def test_running_total_and_crossings(spark):
    df = spark.createDataFrame([(i, 3) for i in range(50)], "i int, v long")
    got = sequence.crossings(df, ["i"], "v", 10, 4).collect()
    assert sorted((r.i, r.n) for r in got) == [(i, n) for i in range(50) for n in range((3 * i) // 10 + 1, (3 * i + 3) // 10 + 1)]


def test_idle_floor_refuses(spark):
    rows = [("ok", float(1 + i % 2)) for i in range(400)] + [("few", 1.0)] * 5 + [("hot", 50.0)] * 400
    got = {r.k: r.refused for r in hardware.idle_floor(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"ok": None, "few": "too few", "hot": "floor too high"}


def test_text_pieces(spark):
    assert last_object('x META:{"a":"}{\\""} META:{bad', "META:")[0] == '{"a":"}{\\""}'
    lines = scan_lines(spark.createDataFrame([(1, "a `b` c\n```\nx\n```\ny")], "k int, t string"), "k", "t")
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["a     c", "", "", "", "y"]
    df = spark.createDataFrame([("a/b", "../c.md?x"), ("a", "./d/../e"), ("a", "/r/s"), ("", "../../q")], "f string, r string")
    assert [r.p for r in df.select(resolve(F.col("f"), F.col("r")).alias("p")).collect()] == ["a/c.md", "a/e", "r/s", "q"]


def test_empty_tables_give_no_rows(spark):
    passes = spark.createDataFrame([], "render int, pass long, ms double, bytes double")
    for f in (fleet.tile_stats, fleet.slow_tile_carry, fleet.time_bytes_corr, fleet.cost_split, fleet.degradation, fleet.tenths):
        assert f(passes).count() == 0
