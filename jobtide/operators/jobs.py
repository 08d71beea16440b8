"""Latest job metadata from the change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.clock import AsOf, column_type, moment
from jobtide.operators.temporal import value_at
from jobtide.schemas import JOB_KEYS

# Settings fields in order of precedence, and the type each one means.
TASK_TYPES = (
    ("tasks", "MULTI_TASK"),
    ("notebook_task", "NOTEBOOK"),
    ("python_wheel_task", "PYTHON_WHEEL"),
    ("jar_task", "JAR"),
)
UNKNOWN_TYPE = "UNKNOWN"


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest_first: Sequence[str]
) -> DataFrame:
    """The newest row of each key by ``newest_first``, compared left to right.

    Spark keeps one row per key and task before the shuffle (WindowGroupLimit), so
    a hot key sends at most one row per map task.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest_first])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def job_type(settings: str = "settings") -> Column:
    """Kind of job by the first settings field that is set."""
    return F.coalesce(
        *[F.when(F.col(f"{settings}.{f}").isNotNull(), F.lit(kind)) for f, kind in TASK_TYPES],
        F.lit(UNKNOWN_TYPE),
    )


def latest_jobs(
    changes: DataFrame, as_of: AsOf = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """One row per job: its latest change record up to ``as_of`` as job metadata.

    Later changes are not read; a job without an earlier one is not there. ``tie_break`` names further columns,
    largest first, for equal change times.
    """
    if as_of is not None:
        changes = changes.where(F.col("change_time") <= moment(as_of, column_type(changes, "change_time")))
    described = changes.select(
        *JOB_KEYS,
        "change_time",
        *tie_break,
        F.col("name").alias("job_name"),
        "owned_by",
        "creator_email",
        "created_time",
        job_type().alias("job_type"),
    )
    return latest_per_key(described, JOB_KEYS, ["change_time", *tie_break]).select(
        *JOB_KEYS,
        "job_name",
        "owned_by",
        "creator_email",
        "created_time",
        "job_type",
        moment(as_of).alias("collected_at"),
    )


def with_metadata_at(
    rows: DataFrame, changes: DataFrame, at: str, names: Sequence[str] = ("name",), tie_break: Sequence[str] = ()
) -> DataFrame:
    """``rows`` with the ``names`` columns of their job's change log that held at the moment ``at`` of each.

    Null where the job had no change record by then.
    """
    return value_at(rows, changes, JOB_KEYS, at, "change_time", names, tie_break)


def sample_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` jobs by key, as a readable sample."""
    return jobs.select(*JOB_KEYS, "job_name", "owned_by", "created_time").orderBy(*JOB_KEYS).limit(n)
