"""Same pictures by a tree of hashes: repeated rows, missing tiles and images, and the shape of marks."""

from fleetlens.operators import raster
from pyspark.sql import functions as F


def pixels(spark, images):
    rows = [(name, x, y, x // 4, y // 4, q) for name, image in images.items() for (x, y), q in image]
    return spark.createDataFrame(rows, "image string, x int, y int, tx int, ty int, q int")


def judged(spark, images, pairs):
    q = pixels(spark, images)
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    rows = raster.same_picture(p, raster.tile_hashes(q, "ty", "tx"), q, ["ty", "tx"], 8, F.col("y") % 4 == 0).collect()
    return {pairs[r.pair]: (r.same, r.tiles, r.differ, r["first"], r.worst, r.mark_shaped) for r in rows}


def test_same_picture(spark):
    base = {(x, y): (x * 31 + y * 17) % 200 for x in range(8) for y in range(8)}
    marked = {k: v + (k[1] % 4 == 0 and k[0] == 5) for k, v in base.items()}
    twice = {k: v + (2 if k == (5, 4) else 0) for k, v in marked.items()}
    aside = {k: v + (k == (1, 2)) for k, v in base.items()}
    images = {n: list(d.items()) for n, d in {"base": base, "copy": base, "marked": marked, "twice": twice, "aside": aside}.items()}
    images["part"] = [(k, v) for k, v in base.items() if k[0] < 4]
    images["again"] = list(base.items()) + [((0, 0), base[0, 0])] * 2  # a pixel repeated: an exclusive or would not see it
    got = judged(spark, images, [("base", n) for n in ("copy", "marked", "twice", "aside", "part", "again", "none")] + [("none", "nil")])
    assert got == {
        ("base", "copy"): (True, 0, 0, None, None, False),
        ("base", "marked"): (False, 2, 2, 5, 1, True),
        ("base", "twice"): (False, 2, 2, 5, 3, False),
        ("base", "aside"): (False, 1, 1, 17, 1, False),
        ("base", "part"): (False, 2, 0, None, None, False),
        ("base", "again"): (False, 1, 0, None, None, False),
        ("base", "none"): (False, 4, 0, None, None, False),
    }
