"""A day's usage shared out to the runs of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.schemas import JOB_KEYS, RUN_KEYS

#: Usage is shared in whole units of this part of one.
UNITS = 1_000_000
SUCCESS = "SUCCESS"


def run_days(slices: DataFrame) -> DataFrame:
    """``run_ms`` and ``succeeded`` per run and date: slices are cut at the borders of days.

    A run has succeeded if its last slice, by start, has. Slices that have no length, or no end, count as 0.
    """
    started, ended = F.col("period_start_time").cast("timestamp"), F.col("period_end_time").cast("timestamp")
    last = F.to_date(F.greatest(ended - F.expr("INTERVAL 1 MICROSECOND"), started))
    midnight = F.col("usage_date").cast("timestamp")
    tomorrow = F.date_add("usage_date", 1).cast("timestamp")
    inside = F.unix_millis(F.least(ended, tomorrow)) - F.unix_millis(F.greatest(started, midnight))
    return (
        slices.where(started.isNotNull())
        .select(
            *RUN_KEYS,
            "period_start_time",
            "period_end_time",
            "result_state",
            F.explode(F.sequence(F.to_date(started), F.coalesce(last, F.to_date(started)))).alias("usage_date"),
        )
        .groupBy(*RUN_KEYS, "usage_date")
        .agg(
            F.sum(F.coalesce(F.greatest(inside, F.lit(0)), F.lit(0))).alias("run_ms"),
            F.coalesce(F.max_by(F.col("result_state") == SUCCESS, "period_start_time"), F.lit(False)).alias("succeeded"),
        )
    )


def run_costs(slices: DataFrame, usage: DataFrame) -> DataFrame:
    """``usage_date, run_id, run_ms, succeeded, cost_units, cost`` per run and date with usage.

    A job's usage of a day is shared by the time that its runs took that day, in millionths: each run gets what the rounded
    running sum grows by, so shares add up to the usage and none is a unit off. Usage of a day on which
    no run of the job took time is a row without run. Runs of a job and day are numbered in
    buckets of their ids, so a hot job's day is many small runs of rows.
    """
    day = [*JOB_KEYS, "usage_date"]
    pieces = run_days(slices).where("run_ms > 0").withColumn("_bucket", F.substring(F.md5("run_id"), 1, 2))
    pieces = pieces.withColumn("_bucket", F.coalesce("_bucket", F.lit("")))
    units = usage.groupBy(*JOB_KEYS, F.col("usage_date").cast("date").alias("usage_date")).agg(
        F.round(F.sum("usage_quantity") * UNITS).cast("long").alias("_units")
    )
    of_day = Window.partitionBy(*day)
    ahead = of_day.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        pieces.groupBy(*day, "_bucket")
        .agg(F.sum("run_ms").alias("_ms"))
        .withColumns({"_total": F.sum("_ms").over(of_day), "_base": F.coalesce(F.sum("_ms").over(ahead), F.lit(0))})
        .join(units, day)
        .select(*day, "_bucket", "_base", "_total", "_units")
    )
    inside = Window.partitionBy(*day, "_bucket").orderBy("run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = pieces.join(bases, [*day, "_bucket"]).withColumn("_upto", F.col("_base") + F.sum("run_ms").over(inside))

    def part(ms: str) -> str:
        return f"((cast(_units as decimal(19,0)) * cast({ms} as decimal(19,0))) div _total)"

    shared = upto.withColumn("cost_units", F.expr(f"{part('_upto')} - {part('_upto - run_ms')}"))
    idle = units.join(pieces.select(*day).distinct(), day, "left_anti").select(
        *day,
        F.lit(None).cast("string").alias("run_id"),
        F.lit(0).cast("long").alias("run_ms"),
        F.lit(None).cast("boolean").alias("succeeded"),
        F.col("_units").alias("cost_units"),
    )
    names = [*day, "run_id", "run_ms", "succeeded", "cost_units"]
    found = shared.select(*names).unionByName(idle)
    return found.withColumn("cost", F.col("cost_units") / UNITS)


def cost_efficiency(costs: DataFrame) -> DataFrame:
    """``score`` per job: the share of its runs' costs that successful runs took; null without costs."""
    spent = costs.where("run_id is not null").groupBy(*JOB_KEYS)
    summed = spent.agg(F.sum("cost_units").alias("_all"), F.sum(F.when(F.col("succeeded"), F.col("cost_units"))).alias("_good"))
    score = F.when(F.col("_all") > 0, F.coalesce("_good", F.lit(0)) / F.col("_all"))
    return summed.select(*JOB_KEYS, score.alias("score"))
