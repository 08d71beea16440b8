"""Duration baselines from mergeable daily statistics.

Each job and date has one row: moments and a quantile sketch of the runs that began then. Rows of a window
are merged in place of its runs, so a month of a job is thirty rows whatever its number of runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.clock import AsOf, elapsed_ms, moment
from jobtide.operators.baselines import BASELINE_COLUMNS, PERCENTILES, SUCCESS_STATES, with_band
from jobtide.schemas import JOB_KEYS, RUN_KEYS

#: Size of a sketch: ranks are off by less than 1 % of the runs, with a probability of 99 %.
SKETCH_K = 400
RANK_ERROR = 0.01


def duration_days(
    slices: DataFrame, success_states: Sequence[str] = SUCCESS_STATES, sketch_k: int = SKETCH_K
) -> DataFrame:
    """``run_date, run_count, mean_ms, m2, min_ms, max_ms, sketch`` per job and date of the runs' first slices.

    ``m2`` is the sum of squared deviations from the mean. A run is the sum of its successful slices,
    all of which have to be in ``slices``. Partial states have a constant size, so a hot job costs nothing extra.
    """
    totals = (
        slices.where(F.col("result_state").isin(*success_states))
        .select(*RUN_KEYS, "period_start_time", elapsed_ms("period_start_time", "period_end_time").alias("_ms"))
        .groupBy(*RUN_KEYS)
        .agg(F.sum("_ms").alias("_total"), F.to_date(F.min("period_start_time")).alias("run_date"))
    )
    return totals.groupBy(*JOB_KEYS, "run_date").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.avg("_total").alias("mean_ms"),
        (F.var_pop("_total") * F.count("_total")).alias("m2"),
        F.min("_total").alias("min_ms"),
        F.max("_total").alias("max_ms"),
        F.kll_sketch_agg_bigint("_total", F.lit(sketch_k)).alias("sketch"),
    )


def merged_baselines(
    stored: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    min_runs: int = 5,
    exclude_recent_days: int = 0,
    sketch_k: int = SKETCH_K,
) -> DataFrame:
    """Baselines of every job with at least ``min_runs`` runs, from ``duration_days``.

    The window consists of whole dates, from ``days`` before ``as_of`` up to it. Counts, means, deviations and extremes are
    exact; the percentiles are durations that occur, with a rank off by ``RANK_ERROR`` at most, and exact
    while a job has fewer runs than ``sketch_k``.
    """
    today = moment(as_of).cast("date")
    window = stored.where(
        (F.col("run_date") >= F.date_sub(today, days)) & (F.col("run_date") <= F.date_sub(today, exclude_recent_days))
    )
    every = Window.partitionBy(*JOB_KEYS)
    centred = window.withColumn(
        "_mean", F.sum(F.col("run_count") * F.col("mean_ms")).over(every) / F.sum("run_count").over(every)
    )
    spread = F.col("m2") + F.col("run_count") * F.pow(F.col("mean_ms") - F.col("_mean"), 2)
    merged = centred.groupBy(*JOB_KEYS).agg(
        F.sum("run_count").alias("total_runs"),
        F.first("_mean").alias("avg_duration_ms"),
        F.sum(spread).alias("_m2"),
        F.min("min_ms").cast("double").alias("min_duration_ms"),
        F.max("max_ms").cast("double").alias("max_duration_ms"),
        F.kll_merge_agg_bigint("sketch", F.lit(sketch_k)).alias("_sketch"),
    )
    n = F.col("total_runs")
    quantiles = {
        name: F.kll_sketch_get_quantile_bigint("_sketch", F.lit(point)).cast("double")
        for name, point in PERCENTILES.items()
    }
    stats = merged.where(n >= min_runs).withColumns(
        {"stddev_duration_ms": F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))), **quantiles}
    )
    return with_band(stats).withColumn("calculated_at", moment(as_of)).select(*BASELINE_COLUMNS)
