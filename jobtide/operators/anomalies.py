"""Jobs whose recent durations stray from their baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, moment, within_days
from jobtide.schemas import JOB_KEYS, RUN_KEYS

# Recent window, default z-score limit, smallest deviation divided by.
RECENT_DAYS = 7
Z_LIMIT = 2.0
DEVIATION_FLOOR = 1.0


def recent_stats(
    runs: DataFrame, as_of: AsOf = None, days: int = RECENT_DAYS, grain: str = "slice"
) -> DataFrame:
    """Mean duration and count per job over the recent window.

    ``grain="slice"`` averages slices as they come; ``grain="run"`` first sums the
    slices of each run, which compares like with like against the baselines.
    """
    recent = runs.where(within_days(runs, "period_start_time", as_of, days))
    if grain == "run":
        recent = recent.groupBy(*RUN_KEYS).agg(F.sum("duration_ms").alias("duration_ms"))
    elif grain != "slice":
        raise ValueError("grain must be 'slice' or 'run'")
    return recent.groupBy(*JOB_KEYS).agg(
        F.avg("duration_ms").alias("recent_avg_duration"),
        F.count(F.lit(1)).alias("recent_run_count"),
    )


def anomalies(
    recent: DataFrame, baselines: DataFrame, as_of: AsOf = None, threshold: float = Z_LIMIT
) -> DataFrame:
    """Jobs whose z-score lies strictly outside ``threshold``, SLOW or FAST."""
    deviation = F.greatest(F.col("stddev_duration_ms"), F.lit(DEVIATION_FLOOR))
    z = F.col("z_score")
    kind = F.when(z > threshold, "SLOW").when(z < -threshold, "FAST")
    return (
        recent.join(
            baselines.select(*JOB_KEYS, "avg_duration_ms", "stddev_duration_ms"), list(JOB_KEYS)
        )
        .withColumn(
            "z_score", (F.col("recent_avg_duration") - F.col("avg_duration_ms")) / deviation
        )
        .where(F.abs(z) > threshold)
        .select(
            *JOB_KEYS,
            kind.alias("anomaly_type"),
            F.abs(z).alias("anomaly_score"),
            "recent_avg_duration",
            "avg_duration_ms",
            "z_score",
            moment(as_of).alias("detected_at"),
        )
    )


def job_anomalies(
    runs: DataFrame,
    baselines: DataFrame,
    as_of: AsOf = None,
    threshold: float = Z_LIMIT,
    days: int = RECENT_DAYS,
    grain: str = "slice",
) -> DataFrame:
    """Performance anomalies of the recent window against the baselines."""
    return anomalies(recent_stats(runs, as_of, days, grain), baselines, as_of, threshold)
