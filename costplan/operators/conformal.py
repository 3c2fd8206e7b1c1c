"""Conformal upper bounds from calibration residuals, split by query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costplan.operators.ordered import numbered
from costplan.session import written

EPS = 1e-9
CELLS = 4096


def residual(actual: Column, predicted: Column, signed: bool = False, eps: float = EPS) -> Column:
    """ln actual - ln predicted, absolute unless signed; values below eps count as eps."""
    r = F.log(F.greatest(actual, F.lit(eps))) - F.log(F.greatest(predicted, F.lit(eps)))
    return r if signed else F.abs(r)


def rank_of(n: Column, delta: Column) -> Column:
    """ceil((n + 1)(1 - delta)), guarded against rounding of the product."""
    return F.ceil((n + 1) * (1 - delta) - 1e-9).cast("long")


def residuals(pool: DataFrame, signed: bool = False, eps: float = EPS) -> DataFrame:
    """(query_id, plan_id, metric, score) for cost and latency of a measured pool."""
    both = F.array(
        F.struct(F.lit("cost").alias("metric"), residual(F.col("actual_cost"), F.col("pred_cost"), signed, eps).alias("score")),
        F.struct(F.lit("latency").alias("metric"), residual(F.col("actual_latency"), F.col("pred_latency"), signed, eps).alias("score")),
    )
    return pool.select("query_id", "plan_id", F.explode(both).alias("r")).select("query_id", "plan_id", "r.metric", "r.score").where(F.col("score").isNotNull())


def positions(scores: DataFrame) -> DataFrame:
    """scores with each row's position among its metric's scores; ties by query and plan."""
    return written(numbered(scores, ["metric"], ["score", "query_id", "plan_id"], F.floor(F.col("score") * CELLS), "position"), "positions")


def quantiles(scores: DataFrame, deltas: Sequence[float], beyond: str = "infinity") -> DataFrame:
    """(metric, delta, n, rank, q, multiplier, rank_exceeds_n): the rank-th smallest score per metric and delta.

    Where the rank exceeds n the bound is infinite ("infinity", certified) or the largest score
    ("largest"). Only two joins on positions; no metric is sorted in one task.
    """
    if beyond not in ("infinity", "largest"):
        raise ValueError("beyond must be infinity or largest")
    spark = scores.sparkSession
    placed = positions(scores)
    sizes = placed.groupBy("metric").agg(F.max("position").alias("n"), F.max("score").alias("largest"))
    wanted = spark.createDataFrame([(float(d),) for d in deltas], "delta double")
    asked = sizes.join(F.broadcast(wanted)).withColumn("rank", rank_of(F.col("n"), F.col("delta")))
    found = asked.join(placed.select("metric", F.col("position").alias("rank"), F.col("score").alias("s")), ["metric", "rank"], "left")
    top = F.lit(float("inf")) if beyond == "infinity" else F.col("largest")
    q = F.when(F.col("rank") > F.col("n"), top).otherwise(F.col("s"))
    return found.select("metric", "delta", "n", "rank", q.alias("q"), F.exp(q).alias("multiplier"), (F.col("rank") > F.col("n")).alias("rank_exceeds_n"))


def leave_one_query_out(scores: DataFrame, delta: float) -> DataFrame:
    """(query_id, metric, n, rank, q): the quantile of all other queries' scores, without a self-join.

    With r_1 < r_2 < ... the positions of a query's own rows in the common order, the k-th score
    of the others stands at position k + #{i : r_i - i + 1 <= k}.
    """
    placed = positions(scores)
    sizes = placed.groupBy("metric").agg(F.max("position").alias("all"))
    own = numbered(placed, ["query_id", "metric"], ["position"], F.floor(F.col("score") * CELLS), "i")
    counts = placed.groupBy("query_id", "metric").agg(F.count(F.lit(1)).alias("m"))
    asked = counts.join(F.broadcast(sizes), "metric").withColumn("n", F.col("all") - F.col("m")).withColumn("rank", rank_of(F.col("n"), F.lit(delta)))
    shift = own.join(asked.select("query_id", "metric", "rank"), ["query_id", "metric"]).groupBy("query_id", "metric").agg(F.count_if(F.col("position") - F.col("i") + 1 <= F.col("rank")).alias("j"))
    at = asked.join(shift, ["query_id", "metric"]).withColumn("position", F.col("rank") + F.col("j"))
    q = F.when(F.col("rank") > F.col("n"), float("inf")).otherwise(F.col("score"))
    return at.join(placed.select("metric", "position", "score"), ["metric", "position"], "left").select("query_id", "metric", "n", "rank", q.alias("q"))


def bounds(pool: DataFrame, cost_multiplier: Column, latency_multiplier: Column) -> DataFrame:
    """pool with cost_upper, cost_lower, latency_upper and latency_lower (never negative)."""
    up = lambda c, m: F.greatest(F.lit(0.0), F.col(c) * m)
    down = lambda c, m: F.greatest(F.lit(0.0), F.col(c) / m)
    return pool.withColumns({
        "cost_upper": up("pred_cost", cost_multiplier), "cost_lower": down("pred_cost", cost_multiplier),
        "latency_upper": up("pred_latency", latency_multiplier), "latency_lower": down("pred_latency", latency_multiplier),
    })


def with_quantiles(pool: DataFrame, q: DataFrame, delta: float) -> DataFrame:
    """pool bounded by the multipliers of one delta; latency falls back to cost where it has none."""
    one = q.where(F.col("delta") == delta).groupBy().agg(F.max(F.when(F.col("metric") == "cost", F.col("multiplier"))).alias("__mc"), F.max(F.when(F.col("metric") == "latency", F.col("multiplier"))).alias("__ml"))
    joined = pool.join(F.broadcast(one))
    return bounds(joined, F.col("__mc"), F.coalesce("__ml", "__mc")).drop("__mc", "__ml")


def coverage(pool: DataFrame, q: DataFrame) -> DataFrame:
    """(metric, delta, n, coverage, violation_rate, mean_margin): how often actual <= predicted * multiplier."""
    long = pool.select(F.explode(F.array(
        F.struct(F.lit("cost").alias("metric"), F.col("actual_cost").alias("a"), F.col("pred_cost").alias("p")),
        F.struct(F.lit("latency").alias("metric"), F.col("actual_latency").alias("a"), F.col("pred_latency").alias("p")),
    )).alias("r")).select("r.*")
    held = long.join(F.broadcast(q.select("metric", "delta", "multiplier")), "metric")
    inside = (F.col("a") <= F.col("p") * F.col("multiplier")).cast("double")
    return held.groupBy("metric", "delta").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(1 - inside).alias("violation_rate"), F.avg(F.try_divide(F.col("p") * F.col("multiplier") - F.col("a"), F.col("a"))).alias("mean_margin"))


def query_split(df: DataFrame, shares: Sequence[tuple[str, float]], seed: str = "0") -> DataFrame:
    """df with part: whole queries dealt to parts by a hash of the query, stable when queries are added."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    total, at, part = sum(s for _, s in shares), 0.0, F.lit(shares[-1][0])
    limits = []
    for name, s in shares[:-1]:
        at += s / total
        limits.append((name, at))
    for name, limit in reversed(limits):
        part = F.when(u < limit, name).otherwise(part)
    return df.withColumn("part", part)
