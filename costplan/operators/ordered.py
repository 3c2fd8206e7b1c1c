"""Positions within ordered groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, name: str = "position") -> DataFrame:
    """df with the 1-based position of each row in its group.

    cell must grow with order (a day of a time, say): rows are ranked within cells, and the
    cells' counts, which are few, give the offsets. Ties beyond order get any order.
    """
    rows = df.withColumn("__cell", cell)
    counts = rows.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__cell"]]
    rank = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(*order))
    ranked = rows.withColumn("__rank", rank).alias("r").join(offsets.alias("o"), same)
    return ranked.select("r.*", (F.col("o.__before") + F.col("r.__rank")).alias(name)).drop("__cell", "__rank")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, cell: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows of its group that come before it.

    As numbered(): totals of cells, which must grow with order, and running sums within a cell.
    """
    rows = df.withColumn("__cell", cell)
    totals = rows.groupBy(*keys, "__cell").agg(F.sum(amount).alias("__t"))
    earlier = F.sum("__t").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "__cell", F.coalesce(earlier, F.lit(0)).alias("__from"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__cell"]]
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("__in", inside).alias("r").join(offsets.alias("o"), same)
    return placed.select("r.*", (F.col("o.__from") + F.col("r.__in")).alias(name)).drop("__cell", "__in")


def latest_upto(df: DataFrame, keys: Sequence[str], order: str, value: Column, cell: Column, name: str) -> DataFrame:
    """df with the greatest non-null value among the rows of its group at or before it in order.

    As numbered(): the greatest of each cell, which must grow with order, a running greatest over
    the cells before, and an ordered pass within the row's own cell.
    """
    rows = df.withColumns({"__cell": cell, "__v": value})
    per_cell = rows.groupBy(*keys, "__cell").agg(F.max("__v").alias("__m"))
    earlier = F.max("__m").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    before = per_cell.select(*keys, "__cell", earlier.alias("__before"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__cell"]]
    inside = F.max("__v").over(Window.partitionBy(*keys, "__cell").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("__in", inside).alias("r").join(before.alias("o"), same)
    return placed.select("r.*", F.coalesce("r.__in", "o.__before").alias(name)).drop("__cell", "__v", "__in")
