"""Running values over a sorted stream that is spread over partitions by range, so that no key has to fit into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], last: tuple[str, ...] = (), following: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with running values over those of equal ``by`` in the given order: ``last_x`` is the last x that is not null up to the row,
    ``next_x`` the first from the row on, ``most_x`` the greatest up to the row.

    Rows are dealt by range of (by, order), so a hot key spreads over partitions; rows that are equal in both are in no certain order. What a
    partition holds of a key at its ends is one row each, and the partitions before and after it add theirs by a join on that small table.
    Rows with a null in ``by`` take part in their partition only, so filter them where that matters.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id())
    dealt = written(dealt, "merged")  # both uses below must see the same partitions
    own, line, rest = Window.partitionBy("_p", *by), Window.partitionBy(*by), (*order, "_tie")
    upward = own.orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    downward = own.orderBy(*[F.desc(c) for c in rest]).rowsBetween(Window.unboundedPreceding, 0)
    near = {f"last_{c}": F.last(c, True).over(upward) for c in last} | {f"next_{c}": F.last(c, True).over(downward) for c in following}
    near |= {f"most_{c}": F.max(c).over(upward) for c in most}
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(*rest))
    ends = [F.max_by(c, place(c)).alias(f"last_{c}") for c in last] + [F.min_by(c, place(c)).alias(f"next_{c}") for c in following]
    ends += [F.max(c).alias(f"most_{c}") for c in most]
    before, after = line.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), line.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_far_last_{c}": F.last(f"last_{c}", True).over(before) for c in last} | {f"_far_next_{c}": F.last(f"next_{c}", True).over(after) for c in following}
    carried |= {f"_far_most_{c}": F.max(f"most_{c}").over(before) for c in most}
    edges = dealt.groupBy("_p", *by).agg(*ends).withColumns(carried).select("_p", *by, *carried)
    out = dealt.withColumns(near).join(edges, ["_p", *by], "left")
    whole = {c: F.greatest(c, f"_far_{c}") if c.startswith("most_") else F.coalesce(c, f"_far_{c}") for c in near}
    return out.withColumns(whole).select(*rows.columns, *near)
