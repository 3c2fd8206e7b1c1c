"""Experiments put together from the operators: sweeps, pruning losses, paired comparisons, stress, search scaling."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.operators import conformal, evaluation, frontier, selection
from costplan.plans import search
from costplan.session import written


def budget_sweep(pool: DataFrame, multipliers: Sequence[float]) -> DataFrame:
    """Per multiplier of a query's least predicted cost: feasible plans, frontier plans, and the fastest choice's means."""
    least = pool.groupBy("query_id").agg(F.min("pred_cost").alias("__least"))
    base = written(pool.join(least, "query_id"), "sweep")
    parts = []
    for m in multipliers:
        fits = base.where(F.col("pred_cost") <= F.lit(float(m)) * F.col("__least"))
        front = frontier.keep_ties(fits)
        chosen = selection.pick(front, ["query_id"], ("pred_latency", "pred_cost", "plan_id"), ("plan_id", "pred_cost", "pred_latency"))
        a = fits.agg(F.count(F.lit(1)).alias("n_feasible"))
        b = front.agg(F.count(F.lit(1)).alias("n_frontier"))
        c = chosen.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("pred_cost").alias("mean_cost"), F.avg("pred_latency").alias("mean_latency"))
        parts.append(a.crossJoin(b).crossJoin(c).withColumn("multiplier", F.lit(float(m))))  # three single rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pruning_loss(plans: DataFrame, keys: Sequence[str], latency: str, kept: Column) -> DataFrame:
    """(keys, n_plans, n_kept, best, best_kept, loss_percent, best_retained) of a restricted candidate set."""
    by = plans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plans"), F.count_if(kept).alias("n_kept"), F.min(latency).alias("best"), F.min(F.when(kept, F.col(latency))).alias("best_kept"))
    return by.withColumns({"loss_percent": (F.try_divide("best_kept", "best") - 1) * 100, "best_retained": F.coalesce(F.col("best_kept") <= F.col("best"), F.lit(False))})


def paired_tests(results: DataFrame, reference: str, keys: Sequence[str], pair: Sequence[str], value: str = "latency", level: str = "strategy_name") -> DataFrame:
    """Signed-rank comparison of every other strategy with the reference within keys, Holm-adjusted.

    results has a row per pair and strategy. p is that of the normal approximation.
    """
    ref = results.where(F.col(level) == reference).select(*keys, *pair, F.col(value).alias("__y"))
    pairs = results.where(F.col(level) != reference).join(ref, [*keys, *pair]).withColumnRenamed(value, "__x")
    tests = evaluation.wilcoxon(written(pairs.select(*keys, level, "__x", "__y"), "pairs"), [*keys, level], "__x", "__y")

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        import math

        return z.map(lambda v: 1.0 if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))

    return evaluation.holm(tests.withColumn("p", two_sided("z")), keys, "p", level)


def stress(pool: DataFrame, factor: Column, deltas: Sequence[float]) -> DataFrame:
    """Coverage of bounds calibrated on the pool as it is, for actual values times a factor per plan."""
    q = conformal.quantiles(conformal.residuals(pool, signed=True), deltas)
    stressed = pool.withColumns({"actual_cost": F.col("actual_cost") * factor, "actual_latency": F.col("actual_latency") * factor})
    return conformal.coverage(stressed, q)


def search_scaling(most: int = 10, widths: Sequence[int] = (20, 50), repeats: int = 3) -> list[dict]:
    """Seconds to search chains of 3 to `most` relations, exhaustively (to five) and by beams; no Spark."""
    found = []
    for n in range(3, most + 1):
        names = [f"t{i}" for i in range(n)]
        edges = {a: {b} for a, b in zip(names, names[1:])}
        score = search.size_scorer(names, {a: 1000.0 / (i + 1) + 1 for i, a in enumerate(names)})
        modes: list[tuple[str, Callable[[], list]]] = [(f"beam_{w}", lambda w=w: search.beam_orders(names, edges, score, w)) for w in widths]  # noqa: B023
        if n <= 5:
            modes.append(("exhaustive", lambda: search.all_orders(names, edges)))  # noqa: B023
        for mode, run in modes:
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                orders = run()
                took.append(time.perf_counter() - began)
            found.append({"n_tables": n, "mode": mode, "n_orders": len(orders), "seconds": sorted(took)[len(took) // 2]})
    return found


def planning_overhead(spark: SparkSession, sql: str, repeats: int = 3) -> dict[str, float]:
    """Median seconds of Spark's own planning and of planning with all alternatives."""
    from costplan.planner import Planner
    from costplan.plans.alternatives import plan_text
    from costplan.plans.shape import QueryRequest

    def median(f: Callable[[], object]) -> float:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return sorted(took)[len(took) // 2]

    plain = median(lambda: plan_text(spark, sql))
    full = median(lambda: Planner(spark).plan(QueryRequest("Q", sql, 1.0)))
    return {"spark_planning": plain, "all_alternatives": full}
