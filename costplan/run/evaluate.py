"""Roll-ups of experiments with the adaptive controller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def policy_summary(runs: DataFrame) -> DataFrame:
    """Per scenario and policy: runs, share within budget, median and largest cost, and the median over the strict policy's.

    runs has scenario, policy, cost and budget, and optionally intervened.
    """
    extra = [F.avg(F.col("intervened").cast("double")).alias("intervention_rate")] if "intervened" in runs.columns else []
    by = runs.groupBy("scenario", "policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("cost") <= F.col("budget")).cast("double")).alias("within_rate"), F.percentile("cost", F.lit(0.5)).alias("median_cost"), F.max("cost").alias("max_cost"), *extra
    )
    strict = by.where("policy = 'strict'").select("scenario", F.col("median_cost").alias("strict_median"))
    return by.join(strict, "scenario", "left").withColumn("ratio_to_strict", F.try_divide("median_cost", "strict_median")).drop("strict_median")
