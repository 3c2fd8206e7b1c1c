"""Telemetry read as a stream: an extension beside the batch reader of sources.logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.sources.logs import TELEMETRY, problem_column


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New telemetry files of a folder, with problems and the event time."""
    df = spark.readStream.schema(TELEMETRY).json(folder)
    return df.withColumns({"problems": problem_column(), "at": F.timestamp_seconds("timestamp")})


def rolled(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs, failures, cost and mean latency per strategy and event-time window; late rows beyond the watermark are dropped."""
    good = stream.where(F.size("problems") == 0).withWatermark("at", late)
    return good.groupBy(F.window("at", window).alias("w"), "strategy").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("actual_cost").alias("cost"), F.avg("latency_ms").alias("mean_latency_ms")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "strategy", "runs", "failures", "cost", "mean_latency_ms")
