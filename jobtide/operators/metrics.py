"""Cluster utilisation from node samples, per day or per short window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, moment, within_calendar_days


def utilisation() -> list[Column]:
    """The aggregates shared by the daily, short-window and streaming metrics."""
    return [
        F.avg(F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias(
            "avg_cpu_usage_percent"
        ),
        F.avg("cpu_idle_percent").alias("avg_cpu_idle_percent"),
        F.avg("mem_used_percent").alias("avg_memory_usage_percent"),
        F.avg(F.col("network_received_bytes") + F.col("network_sent_bytes")).alias(
            "avg_network_bytes"
        ),
        F.count(F.lit(1)).alias("metric_points"),
    ]


def daily_metrics(
    samples: DataFrame, as_of: AsOf = None, days: int = 7, sort: bool = False
) -> DataFrame:
    """Utilisation per cluster and date, from the midnight ``days`` dates back."""
    recent = samples.where(within_calendar_days(samples, "start_time", as_of, days))
    daily = (
        recent.groupBy("cluster_id", F.to_date("start_time").alias("day"))
        .agg(*utilisation())
        .withColumn("collected_at", moment(as_of))
    )
    return daily.orderBy("cluster_id", "day") if sort else daily


def window_metrics(samples: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Utilisation per cluster and tumbling window; works on watermarked streams too."""
    return (
        samples.groupBy("cluster_id", F.window("start_time", width).alias("_w"))
        .agg(*utilisation())
        .select(
            "cluster_id",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "avg_cpu_usage_percent",
            "avg_cpu_idle_percent",
            "avg_memory_usage_percent",
            "avg_network_bytes",
            "metric_points",
        )
    )
