"""Range, nearest and reconciling joins. Shapes that would run as nested loops are equi-joins on dyadic cells, or running values over one
stream in the order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merging import running


def _level(lo: str, hi: str) -> Column:
    """The size class of an interval: 2 ** level is an eighth to a half of its length, so some four to nine cells of that size cover it. Every
    second level is used, which halves what a point has to visit."""
    length = F.greatest(F.col(hi) - F.col(lo), F.lit(0)).cast("double")
    return F.when(length > 0, F.greatest(F.floor((F.log2(length) - 1) / 2) * 2, F.lit(-40))).otherwise(0).cast("int")


def _cell(c: str, level: str) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level)))


def _points_in(points: DataFrame, windows: DataFrame, t: str, lo: str, hi: str, by: tuple[str, ...]) -> DataFrame:
    """Pairs with lo <= t <= hi. A window goes to the few dyadic cells of its own size class that cover it, however long it is; a point goes to
    its cell of each class that occurs among the windows. A point meets a window in one cell at most, so each pair comes once."""
    w = windows.filter(F.col(lo) <= F.col(hi)).withColumn("_level", _level(lo, hi))
    w = w.withColumn("_cell", F.explode(F.sequence(_cell(lo, "_level"), _cell(hi, "_level"))))
    levels = windows.filter(F.col(lo) <= F.col(hi)).agg(F.collect_set(_level(lo, hi)).alias("_levels"))  # one row, of some fifty numbers at most
    s = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    return s.withColumn("_cell", _cell(t, "_level")).join(w, ["_level", "_cell", *by]).filter(F.col(t).between(F.col(lo), F.col(hi))).drop("_level", "_cell")


def samples_in_windows(samples: DataFrame, windows: DataFrame, t: str = "t", lo: str = "t0", hi: str = "t1", by: tuple[str, ...] = ()) -> DataFrame:
    """Samples with lo <= t <= hi, both ends included, by dyadic cells of each window's own size. Null times and windows that end before they
    begin match nothing."""
    return _points_in(samples, windows, t, lo, hi, by)


def outside_all_windows(samples: DataFrame, windows: DataFrame, lead: int, lag: int, t: str = "t", lo: str = "t0", hi: str = "t1", by: tuple[str, ...] = ()) -> DataFrame:
    """Samples in no window widened by ``lead`` before and ``lag`` after. A null time or ``by`` is in no window and stays.

    No pair is built: samples and windows are one stream in the order of time, and a sample is outside where the latest end of all windows
    that began up to it is before it."""
    wide = windows.select(*by, (F.col(lo) - lead).alias("_at"), (F.col(hi) + lag).alias("_end")).filter(F.col("_at") <= F.col("_end"))
    wide = wide.groupBy(*by, "_at").agg(F.max("_end").alias("_end"))
    rows = samples.select(*by, F.col(t).alias("_at"), F.struct(*samples.columns).alias("_row"))
    for b in by:
        wide = wide.filter(F.col(b).isNotNull())
    both = wide.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    seen = running(both, by, ("_at", "_side"), most=("_end",))
    return seen.filter((F.col("_side") == 1) & (F.col("_at").isNull() | F.col("most__end").isNull() | (F.col("most__end") < F.col("_at")))).select("_row.*")


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals that overlap by more than an end point (both comparisons strict): those where the right one begins in the left one,
    and those where the left one begins in the right one after its beginning. No pair is in both. Intervals that end before
    they begin overlap nothing."""
    (a0, a1), (b0, b1) = left_ends, right_ends
    strict = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col(a0) <= F.col(a1)) & (F.col(b0) <= F.col(b1))
    first = _points_in(right, left, b0, a0, a1, by).filter(strict)
    second = _points_in(left, right, a0, b0, b1, by).filter(strict & (F.col(b0) < F.col(a0)))
    return first.unionByName(second.select(*first.columns))


def nearest_in_time(left: DataFrame, right: DataFrame, tol: int, value: str, t: str = "t", rt: str = "rt", by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with near_t and near_value, the nearest right time within ``tol`` (inclusive) and its value; the earlier wins a tie and the
    least value among equal times; null where there is none, and for a null time or ``by``.

    An as-of merge: both sides are one stream in the order of time, the last right row before and the first one after are running values, so
    a busy second costs its rows, not their pairs. Right columns are rt and value."""
    r = right.filter(F.col(rt).isNotNull())
    for b in by:
        r = r.filter(F.col(b).isNotNull())
    r = r.groupBy(*by, rt).agg(F.min(F.struct(value)).alias("_v"))
    r = r.select(*by, F.col(rt).alias("_at"), F.struct(F.col(rt).alias("near_t"), F.col(f"_v.{value}").alias("near_value")).alias("_r"), F.lit(0).alias("_side"))
    rows = left.select(*by, F.col(t).alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"))
    near = running(r.unionByName(rows, allowMissingColumns=True), by, ("_at", "_side"), last=("_r",), following=("_r",)).filter("_side = 1")
    back, ahead = F.col("_at") - F.col("last__r.near_t"), F.col("next__r.near_t") - F.col("_at")
    best = F.when((back <= tol) & (ahead.isNull() | (back <= ahead)), F.col("last__r")).when(ahead <= tol, F.col("next__r"))
    return near.select("_row.*", best["near_t"].alias("near_t"), best["near_value"].alias("near_value"))


def needs_harvest(files: DataFrame, sidecars: DataFrame, key: str, sidecar_key: str) -> DataFrame:
    """Files without a sidecar. A null key has none."""
    return files.join(sidecars.select(F.col(sidecar_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def already_archived(batch: DataFrame, archive: DataFrame, keys: list[str], known: bool = True) -> DataFrame:
    """Rows of the batch whose composite key the archive has (or lacks); nulls equal nulls."""
    a = archive.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return batch.join(a, on, "left_semi" if known else "left_anti")


def match_templates(rows: DataFrame, templates: DataFrame, key: str, fields: list[str], order: str, name: str) -> DataFrame:
    """The first template whose listed fields all equal the row's; a null field of a template matches anything. Rows without one keep a
    null name. Templates are a small dimension: one equi-join for each pattern of listed fields, found from the templates."""
    masks = [r["m"] for r in templates.select(F.concat_ws("", *[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields]).alias("m")).distinct().orderBy("m").limit(1 << len(fields)).collect()]
    mask = F.concat_ws("", *[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    hits = None
    for m in masks:
        use = [f for f, c in zip(fields, m, strict=True) if c == "1"]
        own = templates.filter(mask == m).select(*[F.col(f).alias(f"_{f}") for f in use], order, name)
        if use:
            on = F.col(use[0]) == F.col(f"_{use[0]}")
            for f in use[1:]:
                on = on & (F.col(f) == F.col(f"_{f}"))
            hit = rows.join(own, on).select(key, order, name)
        else:  # a template that lists nothing: only the first can ever win
            hit = rows.crossJoin(own.orderBy(order).limit(1)).select(key, order, name)
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    best = hits.groupBy(key).agg(F.min_by(name, order).alias(name))
    return rows.join(best, key, "left")


def reconcile_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either side once: both, missing (only in a) or stale (only in b)."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "missing").otherwise("stale").alias("status"))


def align_tilings(small: DataFrame, large: DataFrame, k: int) -> DataFrame:
    """Each small tile (image, tx, ty) beside the large one that holds it: large is k x k of the small. Refused with a reason where the
    small grid is no multiple of k or the number of large tiles is not the grid's."""
    ws = small.groupBy("image").agg(F.max("tx").alias("mx"), F.max("ty").alias("my"))
    wl = large.groupBy("image").agg(F.count("*").alias("n"))
    state = ws.join(wl, "image").select("image", F.when(((F.col("mx") + 1) % k != 0) | ((F.col("my") + 1) % k != 0), "sizes do not divide").when(F.col("n") != (F.col("mx") + 1) * (F.col("my") + 1) / (k * k), "tile count").alias("refused"))
    s = small.withColumns({"lx": F.floor(F.col("tx") / k), "ly": F.floor(F.col("ty") / k)})
    big = large.select("image", F.col("tx").alias("lx"), F.col("ty").alias("ly"), F.col("v").alias("large_v"))
    return s.join(big, ["image", "lx", "ly"]).join(state, "image")


def compare_to_reference(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Every member of a group against its earliest, which is left out itself."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.first(value).over(w)
    return rows.withColumns({"reference": first, "_r": F.row_number().over(w)}).filter("_r > 1").withColumn("delta", F.col(value) - F.col("reference")).drop("_r")


def nearest_declaration(pins: DataFrame, decls: DataFrame, name: str, line: str, decl: str) -> DataFrame:
    """Each pin with the declaration line nearest to it (the lower of two as near): exact, moved or undeclared. The last declaration before
    and the first after are running values over the lines of a name, so a name's pins and declarations meet without pairs."""
    rows = pins.select(name, F.col(line).cast("long").alias("_l"), F.lit(None).cast("long").alias("_d")).distinct()
    rows = rows.unionByName(decls.select(name, F.col(decl).cast("long").alias("_l"), F.col(decl).cast("long").alias("_d")).filter("_d is not null"))
    up, down = (Window.partitionBy(name).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("_l", F.desc("_l")))
    near = rows.withColumns({"_a": F.max("_d").over(up), "_b": F.min("_d").over(down)}).filter("_d is null")
    before = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_l") - F.col("_a") <= F.col("_b") - F.col("_l")))
    at = F.when(before, F.col("_a")).otherwise(F.col("_b"))
    kind = dict(pins.dtypes)[line]
    return near.select(name, F.col("_l").cast(kind).alias(line), at.cast(dict(decls.dtypes)[decl]).alias("nearest"), F.when(at.isNull(), "undeclared").when(at == F.col("_l"), "exact").otherwise("moved").alias("status"))


def misfiled(rows: DataFrame, folders: DataFrame, folder: str, device: str) -> DataFrame:
    """Rows whose folder claims another device than their own record; folders without a claim are not judged."""
    return rows.join(folders, folder).filter(F.col("claimed") != F.col(device))


def directory_agrees(entries: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Stored sizes (key, i, size) against recorded ones (key, i, recorded): tiles that differ and the first of them, only where
    both list as many tiles; else no verdict."""
    n = entries.groupBy(key).agg(F.count("*").alias("stored")).join(meta.groupBy(key).agg(F.count("*").alias("listed")), key)
    d = entries.join(meta, [key, "i"]).groupBy(key).agg(F.count_if(F.col("size") != F.col("recorded")).alias("differ"), F.min(F.when(F.col("size") != F.col("recorded"), F.col("i"))).alias("first"))
    same = F.col("stored") == F.col("listed")
    return n.join(d, key).select(key, "stored", "listed", F.when(same, F.col("differ")).alias("differ"), F.when(same, F.col("first")).alias("first"))


def address_check(copies: DataFrame) -> DataFrame:
    """Copies (cell, copy, address) against the cell they stand in: the address that two of a cell's copies agree on is its mark; unmarked
    where none do, in place or moved else."""
    votes = copies.filter("address is not null").groupBy("cell", "address").agg(F.count("*").alias("n")).filter("n >= 2")
    mark = votes.groupBy("cell").agg(F.max_by("address", F.struct("n", "address")).alias("mark"))
    cells = copies.select("cell").distinct()
    return cells.join(mark, "cell", "left").withColumn("status", F.when(F.col("mark").isNull(), "unmarked").when(F.col("mark") == F.col("cell"), "in place").otherwise("moved"))


def shifted_control_join(pixels: DataFrame, dx: int, dy: int, w: int, h: int) -> DataFrame:
    """Each pixel with the value of the raster rolled by (dx, dy)."""
    rolled = pixels.select("image", F.pmod(F.col("x") + dx, F.lit(w)).alias("x"), F.pmod(F.col("y") + dy, F.lit(h)).alias("y"), F.col("v").alias("shifted"))
    return pixels.join(rolled, ["image", "x", "y"])


def occupancy(spans: DataFrame, windows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean number of spans (a0, a1) at work in each window (key, t0, t1): the sum of overlaps over the window's length."""
    hit = overlapping(windows, spans, ("t0", "t1"), ("a0", "a1"), by)
    s = hit.groupBy("key").agg(F.sum(F.least("t1", "a1") - F.greatest("t0", "a0")).alias("busy"))
    return windows.join(s, "key", "left").select("key", F.when(F.col("t1") > F.col("t0"), F.coalesce("busy", F.lit(0)) / (F.col("t1") - F.col("t0"))).alias("occupancy"))


