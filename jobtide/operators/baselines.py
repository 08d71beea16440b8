"""Duration baselines per job over its successful runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, days_before, elapsed_ms, moment, within_days
from jobtide.operators.percentiles import grouped_percentiles, ranked_percentiles
from jobtide.schemas import JOB_KEYS, RUN_KEYS, TABLES

# Success state, percentile points, width of the normal band.
SUCCESS_STATES = ("SUCCESS",)
PERCENTILES = {"median_duration_ms": 0.5, "p90_duration_ms": 0.9}
BAND_DEVIATIONS = 2

BASELINE_COLUMNS = tuple(TABLES["job_baselines"].names)


def run_totals(
    slices: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    success_states: Sequence[str] = SUCCESS_STATES,
    exclude_recent_days: int = 0,
) -> DataFrame:
    """Total duration per successful run, summed over its slices in the window.

    ``exclude_recent_days`` ends the window that many days before ``as_of``, so
    that recent behaviour does not shift the baseline it is compared with.
    """
    chosen = slices.where(
        within_days(slices, "period_start_time", as_of, days)
        & F.col("result_state").isin(*success_states)
    )
    if exclude_recent_days:
        end = days_before(slices, "period_start_time", as_of, exclude_recent_days)
        chosen = chosen.where(F.col("period_start_time") < end)
    return (
        chosen.select(
            *RUN_KEYS, elapsed_ms("period_start_time", "period_end_time").alias("_ms")
        )
        .groupBy(*RUN_KEYS)
        .agg(F.sum("_ms").alias("total_duration_ms"))
    )


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of two frames with one row per key each, side by side.

    A union and a grouping, not a join, for the reason given in ``ranked_percentiles``.
    """
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in both.columns if c not in keys]
    )


def duration_moments(totals: DataFrame) -> DataFrame:
    """Count, mean, deviation and extremes of the run totals per job.

    Constant-size states, combined before the shuffle: a hot job costs nothing extra.
    """
    value = "total_duration_ms"
    return totals.groupBy(*JOB_KEYS).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.avg(value).alias("avg_duration_ms"),
        F.stddev(value).alias("stddev_duration_ms"),
        F.min(value).cast("double").alias("min_duration_ms"),
        F.max(value).cast("double").alias("max_duration_ms"),
    )


def with_percentiles(moments: DataFrame, totals: DataFrame, bounded_groups: bool) -> DataFrame:
    """Moments with the median and 90th percentile of the same totals beside them.

    ``bounded_groups`` promises that every job's runs fit in one task's memory; the
    built-in aggregate then saves the shuffles of the skew-proof ranking.
    """
    exact = grouped_percentiles if bounded_groups else ranked_percentiles
    return merged(moments, exact(totals, JOB_KEYS, "total_duration_ms", PERCENTILES), JOB_KEYS)


def with_band(stats: DataFrame) -> DataFrame:
    """Add the normal band and the coefficient of variation."""
    spread = F.coalesce("stddev_duration_ms", F.lit(0.0))
    mean = F.col("avg_duration_ms")
    variation = F.when(mean > 0, spread / mean).otherwise(F.lit(0.0))
    return stats.withColumns(
        {
            "upper_threshold_ms": mean + BAND_DEVIATIONS * spread,
            "lower_threshold_ms": mean - BAND_DEVIATIONS * spread,
            "coefficient_of_variation": variation,
        }
    )


def job_baselines(
    slices: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    min_runs: int = 5,
    success_states: Sequence[str] = SUCCESS_STATES,
    exclude_recent_days: int = 0,
    percentiles: bool = True,
    bounded_groups: bool = False,
) -> DataFrame:
    """Baselines of every job with at least ``min_runs`` successful runs.

    Health and anomalies read only the moments: ``percentiles=False`` leaves the two
    percentile columns out where the result is not stored.
    """
    totals = run_totals(slices, as_of, days, success_states, exclude_recent_days)
    stats = duration_moments(totals)
    if percentiles:
        stats = with_percentiles(stats, totals, bounded_groups)
    stored = [c for c in BASELINE_COLUMNS if percentiles or c not in PERCENTILES]
    return (
        with_band(stats.where(F.col("total_runs") >= min_runs))
        .withColumn("calculated_at", moment(as_of))
        .select(*stored)
    )
