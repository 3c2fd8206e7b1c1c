"""Pareto frontiers of cost and latency within queries.

The frontier of a union is the frontier of its parts' frontiers. So a query's plans are first
thinned within `salts` hash parts and then once more, which keeps a query of a third of all
rows out of any single task. Nothing compares pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def _log(c: str) -> Column:
    """ln with zero (or less) far below everything, so that a relative tolerance is a distance."""
    return F.when(F.col(c) > 0, F.log(c)).otherwise(F.lit(-1e6))


def _thin(df: DataFrame, keys: list[str], cost: str, latency: str, tolerance: float) -> DataFrame:
    """Rows that no row of the same keys beats; ties stay."""
    rows = df.withColumns({"__c": _log(cost), "__l": _log(latency)})
    # Range frames on ln cost: rows cheaper by more than the tolerance, and rows about as cheap or cheaper.
    names = ", ".join(f"`{k}`" for k in keys)
    cheaper = F.expr(f"min(__l) OVER (PARTITION BY {names} ORDER BY __c RANGE BETWEEN UNBOUNDED PRECEDING AND {tolerance!r}D PRECEDING)")
    level = F.expr(f"min(__l) OVER (PARTITION BY {names} ORDER BY __c RANGE BETWEEN UNBOUNDED PRECEDING AND {tolerance!r}D FOLLOWING)")
    # Beaten: someone strictly cheaper is not slower, or someone not dearer is strictly faster.
    beaten = (F.coalesce(F.col("__cheaper") <= F.col("__l") + tolerance, F.lit(False))) | (F.col("__level") < F.col("__l") - tolerance)
    return rows.withColumns({"__cheaper": cheaper, "__level": level}).where(~beaten).drop("__c", "__l", "__cheaper", "__level")


def keep_ties(df: DataFrame, key: str = "query_id", cost: str = "pred_cost", latency: str = "pred_latency", plan: str = "plan_id", tolerance: float = 1e-9, salts: int = SALTS) -> DataFrame:
    """All rows that no plan of the query dominates (relative tolerance); equal plans all stay.

    Rows with a null key, cost or latency are on no frontier.
    """
    known = df.where(F.col(key).isNotNull() & F.col(cost).isNotNull() & F.col(latency).isNotNull())
    if salts > 1:
        parts = known.withColumn("__part", F.pmod(F.xxhash64(plan), F.lit(salts)))
        known = _thin(parts, [key, "__part"], cost, latency, tolerance).drop("__part")
    return _thin(known, [key], cost, latency, tolerance)


def sort_scan(df: DataFrame, key: str = "query_id", cost: str = "pred_cost", latency: str = "pred_latency", plan: str = "plan_id", tolerance: float = 1e-9, salts: int = SALTS) -> DataFrame:
    """The frontier with equal points collapsed: a leader each (least plan), n_equivalent and their ids.

    One scan in the order of cost keeps a plan that is faster than all before it by more than the
    absolute tolerance.
    """
    points = df.where(F.col(key).isNotNull() & F.col(cost).isNotNull() & F.col(latency).isNotNull())
    if salts > 1:
        points = _scan(points.withColumn("__part", F.pmod(F.xxhash64(plan), F.lit(salts))), [key, "__part"], cost, latency, plan, tolerance, False).drop("__part")
    return _scan(points, [key], cost, latency, plan, tolerance, True)


def _scan(df: DataFrame, keys: list[str], cost: str, latency: str, plan: str, tolerance: float, collapse: bool) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(cost, latency, plan)
    before = F.min(latency).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = df.withColumn("__before", before)
    kept = F.col("__before").isNull() | (F.col(latency) < F.col("__before") - tolerance)
    if not collapse:
        # Equal points stay until the last scan, which counts them.
        equal = (F.abs(F.col(cost) - F.col("__cost")) <= tolerance) & (F.abs(F.col(latency) - F.col("__lat")) <= tolerance)
        lead = F.last(F.when(kept, F.struct(F.col(cost).alias("c"), F.col(latency).alias("l"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marked = first.withColumns({"__lead": lead, "__keep": kept}).withColumns({"__cost": F.col("__lead.c"), "__lat": F.col("__lead.l")})
        return marked.where(F.col("__keep") | equal).drop("__before", "__lead", "__keep", "__cost", "__lat")
    lead = F.last(F.when(kept, F.struct(F.col(cost).alias("c"), F.col(latency).alias("l"), F.col(plan).alias("p"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = first.withColumns({"__lead": lead, "__keep": kept})
    equal = (F.abs(F.col(cost) - F.col("__lead.c")) <= tolerance) & (F.abs(F.col(latency) - F.col("__lead.l")) <= tolerance)
    groups = marked.where(F.col("__keep") | equal).groupBy(*keys, F.col("__lead.p").alias("__leader")).agg(F.count(F.lit(1)).alias("n_equivalent"), F.sort_array(F.collect_list(plan)).alias("equivalents"))
    leaders = marked.where("__keep").drop("__before", "__lead", "__keep")
    return leaders.join(groups.withColumnRenamed("__leader", plan), [*keys, plan])
