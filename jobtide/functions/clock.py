"""Time expressions around one fixed ``as_of`` moment.

``as_of`` is a naive UTC string or datetime, a Column, or None for the time the
query starts. Bounds are built as foldable literals of the column's own type, so
the comparison leaves the column bare and reaches the parquet scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = str | datetime | Column | None


def moment(as_of: AsOf = None, dtype: str = "timestamp") -> Column:
    """``as_of`` as a column of type ``dtype``."""
    if as_of is None:
        return F.current_timestamp().cast(dtype)
    if isinstance(as_of, Column):
        return as_of.cast(dtype)
    return F.lit(str(as_of)).cast(dtype)


def column_type(df: DataFrame, column: str) -> str:
    """The type of a column, as text."""
    return df.schema[column].dataType.simpleString()


def days_before(df: DataFrame, column: str, as_of: AsOf, days: int) -> Column:
    """The moment ``days`` days before ``as_of``, typed like ``df[column]``."""
    return moment(as_of, column_type(df, column)) - F.make_dt_interval(days=F.lit(days))


def within_days(df: DataFrame, column: str, as_of: AsOf, days: int) -> Column:
    """Predicate: ``column`` is at most ``days`` times 24 hours older than ``as_of``, and not later."""
    latest = moment(as_of, column_type(df, column))
    return (F.col(column) >= days_before(df, column, as_of, days)) & (F.col(column) <= latest)


def within_calendar_days(df: DataFrame, column: str, as_of: AsOf, days: int) -> Column:
    """Predicate: from the midnight ``days`` dates before ``as_of`` up to ``as_of``."""
    day = F.date_sub(moment(as_of).cast("date"), days)
    kind = column_type(df, column)
    return (F.col(column) >= day.cast(kind)) & (F.col(column) <= moment(as_of, kind))


def elapsed_ms(start: str, end: str) -> Column:
    """Whole milliseconds from ``start`` to ``end`` as BIGINT."""
    return F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(
        F.col(start).cast("timestamp")
    )


def epoch_seconds(column: Column) -> Column:
    """Whole seconds since 1970 of a timestamp column."""
    return F.unix_seconds(column.cast("timestamp"))
