"""Running telemetry over a stream of query events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rates(agg: DataFrame) -> DataFrame:
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total_queries").cast("double")), F.lit(0.0))
    return agg.withColumn("empty_rate", rate("empty_results")).withColumn("fallback_rate", rate("fallback_count"))


def _counts():
    return [
        F.count(F.lit(1)).alias("total_queries"),
        F.sum(F.col("is_empty").cast("int")).alias("empty_results"),
        F.sum(F.col("used_fallback").cast("int")).alias("fallback_count"),
    ]


def stream_totals(events: DataFrame) -> DataFrame:
    """Running totals; write in complete or update mode."""
    return _rates(events.groupBy().agg(*_counts()))


def windowed(events: DataFrame, width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Totals per endpoint and time window; events later than the delay drop out of a stream."""
    src = events.withWatermark("ts", delay) if delay else events
    agg = src.groupBy(F.window("ts", width).alias("w"), "endpoint").agg(*_counts())
    return _rates(agg).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint",
        "total_queries", "empty_results", "fallback_count", "empty_rate", "fallback_rate",
    )
