"""Order statistics with the rule said out loud, and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson r as an aggregate, null where either side does not vary over the pairs that have both."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _place(n: Column, q: float, rule: str) -> Column:
    return F.least(F.floor(n * q), n - 1) if rule == "upper" else F.greatest(F.ceil(n * q) - 1, F.lit(0))


def exact_rank(df: DataFrame, keys: list[str], value: str, q: float, rule: str) -> DataFrame:
    """The q-quantile of ``value`` for each key, by row_number: a sort that spills, never a collected list.

    rule: ``upper`` floor(n * q), counted from 0; ``nearest`` ceil(n * q) - 1, at least 0. Null values do not count; keys
    without values give no row.
    """
    rows = df.filter(F.col(value).isNotNull())
    if not keys:
        return whole_ranks(rows, value, {value: q}, rule).filter(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), _place(F.count(value).over(w), q, rule).alias("_at"))
    return ranked.filter("_i = _at").select(*keys, value)


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = 1000) -> DataFrame:
    """Exact quantiles for each key, interpolated between ranks as ``percentile`` does: keys and a column for each name of ``wanted`` (column, q).

    A mergeable sketch of bounded size brackets each rank first: its error is below n / ``accuracy``, the bracket two of those wide on either
    side; groups of less than four times ``accuracy`` values are taken whole. Then only counts by value inside the bracket, and one count on either side of it, are shuffled and ranked. So no aggregate
    holds a group's values, however many differ. Null values do not count; a key without values of a column has a null there.
    """
    names = list(wanted)
    near = sorted({min(1.0, max(0.0, q + d / accuracy)) for _, q in wanted.values() for d in (-2, 2)})
    pick = lambda f: F.element_at(F.array(*[f(wanted[name][1]) for name in names]), F.col("_i") + 1)
    end = lambda sign: lambda q: F.lit(None).cast("double") if not 0 < q + 2 * sign / accuracy < 1 else F.col("_s")[near.index(q + 2 * sign / accuracy)]
    tall = df.select(*keys, F.posexplode(F.array(*[F.col(c).cast("double") for c, _ in wanted.values()])).alias("_i", "_v")).filter("_v is not null")
    sketch = tall.groupBy(*keys, "_i").agg(F.count("*").alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_s"))
    bracket = sketch.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_i")], "_n", *[F.when(F.col("_n") >= 4 * accuracy, pick(end(sign))).alias(name) for sign, name in ((-1, "_lo"), (1, "_hi"))])
    met = tall.join(bracket, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_i")])
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    counts = met.groupBy(*keys, "_i", "_n", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_at")).agg(F.count("*").alias("_c"))
    seen = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_side", "_at").rowsBetween(Window.unboundedPreceding, 0))
    place = pick(lambda q: F.lit(float(q))) * (F.col("_n") - 1)
    ranked = counts.withColumns({"_seen": seen, "_place": place}).filter("_side = 0")
    found = ranked.groupBy(*keys, "_i").agg(*[F.min(F.when(F.col("_seen") > f("_place"), F.col("_at"))).alias(name) for f, name in ((F.floor, "_a"), (F.ceil, "_b"))], F.first("_place").alias("_place"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(name) for i, name in enumerate(names)])


def whole_ranks(df: DataFrame, value: str, wanted: dict[str, float], rule: str, accuracy: int = 10_000) -> DataFrame:
    """One row: the quantiles of a whole table by the rules of ``exact_rank``, a column for each name of ``wanted``; null where there are no values.

    As in ``quantiles`` a sketch of bounded size brackets each rank, and only counts by value inside the brackets, and one count for each gap
    between them, are ranked: some 4 / ``accuracy`` of the rows for each rank, or all of a table of less than four times ``accuracy``. As each
    side is an aggregate of a single row, cross joins with it cost nothing; those with a table that may have many partitions multiply them.
    """
    rows = df.select(F.col(value).alias("_v")).filter("_v is not null")
    near = sorted({min(1.0, max(0.0, q + d / accuracy)) for q in wanted.values() for d in (-2, 2)})
    end = lambda q, d: F.col("_s")[near.index(min(1.0, max(0.0, q + d / accuracy)))]
    sketch = rows.agg(F.count("*").alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_s"))
    inside = F.col("_n") < 4 * accuracy
    for q in wanted.values():
        inside = inside | F.col("_v").between(end(q, -2), end(q, 2))
    below = F.when(F.col("_n") < 4 * accuracy, 0).otherwise(sum((F.col("_v") > F.col("_s")[i]).cast("int") for i in range(len(near))))
    met = rows.crossJoin(F.broadcast(sketch))  # a single row
    counts = met.groupBy("_n", below.alias("_gap"), F.when(inside, F.col("_v")).alias("_at")).agg(F.count("*").alias("_c"))
    seen = F.sum("_c").over(Window.orderBy("_gap", "_at").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_seen", seen).agg(*[F.min(F.when(F.col("_seen") > _place(F.col("_n"), q, rule), F.col("_at"))).alias(name) for name, q in wanted.items()])
