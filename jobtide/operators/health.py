"""Weighted health score per job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, epoch_seconds, moment
from jobtide.functions.scores import (
    ATTENTION_BELOW,
    HEALTH_WEIGHTS,
    PLACEHOLDER_SCORES,
    check_weights,
    health_category,
    stability_score,
    success_rate_score,
    weighted_score,
)
from jobtide.schemas import JOB_KEYS


def success_rates(runs: DataFrame) -> DataFrame:
    """Run counts, success rate and its score per job; a null state is no success."""
    return (
        runs.groupBy(*JOB_KEYS)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("result_state") == "SUCCESS").alias("successful_runs"),
        )
        .withColumn("success_rate", F.col("successful_runs") / F.col("total_runs"))
        .withColumn("success_rate_score", success_rate_score(F.col("success_rate")))
    )


def stability(baselines: DataFrame) -> DataFrame:
    """Stability score per job from its coefficient of variation."""
    return baselines.select(
        *JOB_KEYS,
        stability_score(F.col("coefficient_of_variation")).alias("stability_score"),
        "coefficient_of_variation",
    )


# Scores of a falling, level and rising duration trend (own choice, level = placeholder).
TREND_SCORES = {-1: 1.0, 0: PLACEHOLDER_SCORES["trend_analysis"], 1: 0.2}


def duration_trend(runs: DataFrame) -> DataFrame:
    """Direction of run durations per job: ``trend`` -1, 0 or 1 and its ``score``."""
    slope = F.regr_slope("duration_ms", epoch_seconds(F.col("period_start_time")))
    trend = F.coalesce(F.signum("_slope"), F.lit(0.0)).cast("int")
    score = F.coalesce(
        *[F.when(F.col("trend") == t, F.lit(s)) for t, s in TREND_SCORES.items()]
    )
    return (
        runs.groupBy(*JOB_KEYS)
        .agg(slope.alias("_slope"))
        .select(*JOB_KEYS, trend.alias("trend"))
        .withColumn("score", score)
    )


def job_health(
    jobs: DataFrame,
    runs: DataFrame,
    baselines: DataFrame,
    as_of: AsOf = None,
    weights: Mapping[str, float] = HEALTH_WEIGHTS,
    components: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Health of every known job; jobs without runs or baselines keep nulls there.

    ``components`` may supply (workspace_id, job_id, score) frames for
    cost_efficiency, resource_utilization or trend_analysis in place of their
    placeholder scores.
    """
    check_weights(weights)
    components = dict(components or {})
    unknown = set(components) - set(PLACEHOLDER_SCORES)
    if unknown:
        raise ValueError(f"unknown health components: {sorted(unknown)}")
    keys = list(JOB_KEYS)
    health = (
        jobs.select(*keys, "job_name", "owned_by")
        .join(success_rates(runs), keys, "left")
        .join(stability(baselines), keys, "left")
    )
    parts = {
        "success_rate": F.coalesce("success_rate_score", F.lit(0.0)),
        "performance_stability": F.coalesce("stability_score", F.lit(0.0)),
    }
    for name, placeholder in PLACEHOLDER_SCORES.items():
        parts[name] = F.lit(placeholder)
        if name in components:
            given = components[name].select(*keys, F.col("score").alias(f"_{name}"))
            health = health.join(given, keys, "left")
            parts[name] = F.coalesce(f"_{name}", F.lit(placeholder))
    score = F.col("health_score")
    return health.withColumn("health_score", weighted_score(parts, weights)).select(
        *keys,
        "job_name",
        "owned_by",
        "total_runs",
        "successful_runs",
        "health_score",
        health_category(score).alias("health_category"),
        (score < ATTENTION_BELOW).alias("requires_attention"),
        "success_rate",
        "success_rate_score",
        "stability_score",
        "coefficient_of_variation",
        moment(as_of).alias("calculated_at"),
    )
