"""Daily usage per job and its jumps over the trailing average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.clock import AsOf, column_type, moment
from jobtide.schemas import JOB_KEYS

TRAILING_ROWS = 7
SPIKE_RATIO = 1.5


def _daily(usage: DataFrame, as_of: AsOf, since: Column | None = None) -> DataFrame:
    """Usage per job and day, up to the date of ``as_of``; the bounds reach the scan."""
    kind = column_type(usage, "usage_date")
    if as_of is not None:
        usage = usage.where(F.col("usage_date") <= moment(as_of).cast("date").cast(kind))
    if since is not None:
        usage = usage.where(F.col("usage_date") >= since.cast(kind))
    return usage.groupBy(*JOB_KEYS, "usage_date").agg(F.sum("usage_quantity").alias("usage"))


def _beside_average(daily: DataFrame, trailing_rows: int) -> DataFrame:
    before = (
        Window.partitionBy(*JOB_KEYS).orderBy("usage_date").rowsBetween(-trailing_rows, -1)
    )
    ratio = F.when(F.col("trailing_avg") > 0, F.col("usage") / F.col("trailing_avg"))
    return daily.withColumn("trailing_avg", F.avg("usage").over(before)).withColumn(
        "cost_ratio", ratio
    )


def daily_costs(usage: DataFrame, trailing_rows: int = TRAILING_ROWS, as_of: AsOf = None) -> DataFrame:
    """Usage per job and day beside the average of its previous days with usage.

    The window runs over daily sums, so a hot job brings one row per day to it. Days after
    ``as_of`` are not read.
    """
    return _beside_average(_daily(usage, as_of), trailing_rows)


def costs_since(
    usage: DataFrame, stored: DataFrame, since: Column, as_of: AsOf = None, trailing_rows: int = TRAILING_ROWS
) -> DataFrame:
    """As ``daily_costs`` from the day ``since`` on, with earlier days taken from stored costs.

    Only newer usage is read, and of the stored days each job's last ``trailing_rows``.
    """
    columns = [*JOB_KEYS, "usage_date", "usage"]
    newest = Window.partitionBy(*JOB_KEYS).orderBy(F.col("usage_date").desc())
    before = (
        stored.where(F.col("usage_date") < since)
        .select(*columns, F.row_number().over(newest).alias("_nth"))
        .where(F.col("_nth") <= trailing_rows)
        .select(*columns)
    )
    both = _daily(usage, as_of, since).select(*columns).unionByName(before)
    return _beside_average(both, trailing_rows).where(F.col("usage_date") >= since)


def cost_spikes(costs: DataFrame, ratio: float = SPIKE_RATIO) -> DataFrame:
    """Days whose usage exceeds ``ratio`` times the trailing average."""
    return costs.where(F.col("cost_ratio") > ratio)
