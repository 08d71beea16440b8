"""Run slices of the lookback window with their durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, elapsed_ms, moment, within_days
from jobtide.schemas import SOURCES

SLICE_COLUMNS = tuple(SOURCES["run_slices"].names)


def project_runs(slices: DataFrame, as_of: AsOf = None, extra: Sequence[str] = ()) -> DataFrame:
    """Run columns, ``extra`` ones, ``duration_ms`` and the load stamp; works on streams too."""
    return slices.select(
        *SLICE_COLUMNS,
        *extra,
        elapsed_ms("period_start_time", "period_end_time").alias("duration_ms"),
        moment(as_of).alias("collected_at"),
    )


def job_runs(
    slices: DataFrame, as_of: AsOf = None, days: int = 30, newest_first: bool = False
) -> DataFrame:
    """Slices started within ``days`` of ``as_of``.

    ``newest_first`` costs a range shuffle; ask for it only to look at the rows.
    """
    runs = project_runs(slices.where(within_days(slices, "period_start_time", as_of, days)), as_of)
    return runs.orderBy(F.col("period_start_time").desc()) if newest_first else runs
