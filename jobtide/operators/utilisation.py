"""How busy clusters were while a job ran on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.temporal import CELL_SECONDS, sums_at
from jobtide.schemas import JOB_KEYS

SAMPLE_SECONDS = 60
#: Busy percent from which on a job uses its clusters in full (own choice).
FULL_AT = 60.0
#: Microseconds are counted from 2020 on, which leaves sums of them their digits.
_ORIGIN = 1_577_836_800_000_000


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) - _ORIGIN


def job_utilisation(
    slices: DataFrame,
    samples: DataFrame,
    job_clusters: DataFrame,
    sample_seconds: int = SAMPLE_SECONDS,
    full_at: float = FULL_AT,
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """``covered_seconds, busy_percent, score`` per job: CPU use of its clusters' nodes while its slices ran.

    A sample speaks for the ``sample_seconds`` after its time. Each moment that a slice and a sample share counts once
    for every pair of them, so ``busy_percent`` is the mean weighted by exact overlap, and null
    without any. ``job_clusters`` holds ``workspace_id, job_id, cluster_id``; slices without an end,
    samples without a time or a CPU value, and jobs without a cluster have no part.

    No slice meets a sample: the integral of all samples up to a moment is a running sum over the borders of
    samples, so each slice looks up two of them, at its start and its end.
    """
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    begin = F.col("start_time").cast("timestamp")
    end = begin + F.make_dt_interval(secs=F.lit(sample_seconds).cast("decimal(18,6)"))
    borders = F.array(
        F.struct(begin.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d"))
    )
    steps = (
        samples.where(cpu.isNotNull())
        .select("cluster_id", cpu.alias("_cpu"), F.explode(borders).alias("_b"))
        .select("cluster_id", F.col("_b.t").alias("_border"), F.col("_b.d").alias("_delta"), "_cpu")
    )
    at = _micros("_border")
    running = {
        "_n": F.col("_delta"),
        "_nt": F.col("_delta") * at,
        "_c": F.col("_delta") * F.col("_cpu"),
        "_ct": F.col("_delta") * F.col("_cpu") * at,
    }
    started, ended = (F.col(f"period_{side}_time").cast("timestamp") for side in ("start", "end"))
    ends = F.array(
        F.struct(started.alias("t"), F.lit(-1).alias("s")), F.struct(ended.alias("t"), F.lit(1).alias("s"))
    )
    asked = (
        slices.where(ended > started)
        .select(*JOB_KEYS, F.explode(ends).alias("_e"))
        .join(job_clusters.select(*JOB_KEYS, "cluster_id").distinct(), list(JOB_KEYS))
        .select(*JOB_KEYS, "cluster_id", F.col("_e.t").alias("_at"), F.col("_e.s").alias("_sign"))
    )
    found = sums_at(asked, steps, ["cluster_id"], "_at", "_border", running, cell_seconds)
    t = _micros("_at")
    covered = F.col("_sign") * F.coalesce(F.col("_n") * t - F.col("_nt"), F.lit(0))
    busy = F.col("_sign") * F.coalesce(F.col("_c") * t - F.col("_ct"), F.lit(0.0))
    summed = found.groupBy(*JOB_KEYS).agg(F.sum(covered).alias("_covered"), F.sum(busy).alias("_busy"))
    percent = F.when(F.col("_covered") > 0, F.col("_busy") / F.col("_covered"))
    return (
        summed.withColumn("busy_percent", percent)
        .withColumn("covered_seconds", F.col("_covered") / 1e6)
        .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("busy_percent") / full_at)))
        .withColumn("score", F.when(F.col("busy_percent").isNotNull(), F.col("score")))
        .select(*JOB_KEYS, "covered_seconds", "busy_percent", "score")
    )
