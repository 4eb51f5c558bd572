"""Positions of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import bytes_of, cut, small_or_shuffled


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """``df`` with the long column ``name``: the row's place from 0 among the rows of its group, in ascending ``order``.

    Rows are dealt by ranges of (group, order) and sorted there, so a group of any size spreads over many tasks.  A
    group's rows before a range are a running sum over one row for each (group, range).  Nulls come first; rows that
    agree in group and order are numbered in turn, and share a task, so ``order`` should end with a column that tells
    them apart.  ``total`` names a second column for the rows of the group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number holds the task and, in its low 33 bits, the row's place there; the cut fixes both.
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    ranges = placed.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*by, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("__total"))
    ranges = cut(ranges.withColumnsRenamed({c: f"__by_{k}" for k, c in enumerate([*by, "__part"])}))
    same: Column = F.lit(True)
    for k, c in enumerate([*by, "__part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{k}"))
    out = placed.join(small_or_shuffled(ranges, bytes_of(ranges)), same)
    columns = [F.col(f"`{c}`") for c in df.columns]
    columns.append((F.col("__at") + F.col("__shift")).alias(name))
    return out.select(*columns, *([F.col("__total").alias(total)] if total else []))
