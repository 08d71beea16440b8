"""Reports over the written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.schemas import JOB_KEYS


def recent_pipeline_runs(run_log: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` pipeline runs."""
    return (
        run_log.orderBy(F.col("start_time").desc(), "run_id")
        .limit(n)
        .select(
            "run_id", "status", "start_time", "duration_seconds", "records_processed", "alerts_sent"
        )
    )


def unhealthiest_jobs(health: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` lowest-scoring jobs among those that require attention."""
    return (
        health.where("requires_attention")
        .orderBy("health_score", *JOB_KEYS)
        .limit(n)
        .select("job_name", "owned_by", "health_score", "health_category", "requires_attention")
    )
