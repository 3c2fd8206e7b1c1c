"""The canonical plan pool: each customer is a query, each of its orders a candidate plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.session import table


def plan_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, plan_id, strategy, pred_cost, actual_cost, pred_latency, actual_latency).

    Sums are decimal, so they don't depend on the order of rows.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_discount").cast("decimal(4,2)").alias("discount"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"), F.col("l_quantity").cast("decimal(6,0)").alias("quantity"),
    )
    one = F.lit(1)
    sums = items.groupBy("l_orderkey").agg(
        F.sum("price").cast("double").alias("pred_cost"), F.sum(F.col("price") * (one - F.col("discount")) * (one + F.col("tax"))).cast("double").alias("actual_cost"),
        F.sum("quantity").cast("double").alias("pred_latency"), F.sum(F.col("quantity") * (one + F.col("tax"))).cast("double").alias("actual_latency"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_orderpriority").alias("strategy"))
    return orders.join(sums, orders["plan_id"] == sums["l_orderkey"]).drop("l_orderkey")


SQL = """
plan_pool AS (SELECT o.o_custkey AS query_id, o.o_orderkey AS plan_id, o.o_orderpriority AS strategy,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS pred_cost,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))*(1-CAST(l.l_discount AS DECIMAL(4,2)))*(1+CAST(l.l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS actual_cost,
  CAST(SUM(CAST(l.l_quantity AS DECIMAL(6,0))) AS DOUBLE) AS pred_latency,
  CAST(SUM(CAST(l.l_quantity AS DECIMAL(6,0))*(1+CAST(l.l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS actual_latency
FROM orders o JOIN lineitem l ON o.o_orderkey=l.l_orderkey GROUP BY 1,2,3)"""


def budgeted(pool: DataFrame) -> DataFrame:
    """pool with a budget of 1.5 times the query's least predicted cost and a deadline of 3 times its least latency."""
    least = pool.groupBy("query_id").agg((F.lit(1.5) * F.min("pred_cost")).alias("budget"), (F.lit(3.0) * F.min("pred_latency")).alias("deadline"))
    return pool.join(least, "query_id")


BUDGET_SQL = """
b AS (SELECT p.*, 1.5::DOUBLE * min(pred_cost) OVER (PARTITION BY query_id) AS budget, 3.0::DOUBLE * min(pred_latency) OVER (PARTITION BY query_id) AS deadline FROM plan_pool p)"""
