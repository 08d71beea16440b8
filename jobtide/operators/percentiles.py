"""Exact percentiles of integer values that stay exact and bounded for hot groups.

The built-in ``percentile`` keeps every distinct value of a group in one task's
memory. Here values are counted, counts are summed per bucket of 2**20 adjacent
values, and only the buckets that hold a wanted rank are opened. No window sees more
of a group than its bucket totals (2,472 for millisecond durations up to 30 days) or
the distinct values of one bucket (about a million narrow rows, sorted with spill).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BUCKET_BITS = 20


def _position(point: float) -> str:
    """SQL for the zero-based, possibly fractional, rank of a percentile."""
    return f"({float(point)}D * (_total - 1))"


def _holds(rank: str, count: str) -> str:
    """SQL predicate: the rank falls among the ``count`` values after ``_before``."""
    return f"({rank} >= _before AND {rank} < _before + {count})"


def _earlier(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def ranked_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """``keys`` plus one DOUBLE per entry of ``points`` (name to fraction).

    Interpolates linearly between neighbouring ranks and ignores null values, like
    the built-in. ``value`` must be an integer column.

    The wanted buckets come back to their values as marker rows in a union instead of
    a join: a join would push null checks on its keys into one branch only, and the
    branches would then no longer share the scan and shuffles of ``df``.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("bigint").alias("_value"))
        .groupBy(*keys, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.shiftright("_value", BUCKET_BITS).alias("_bucket"), "_value", "_n")
    )
    wanted = [
        _holds(f"{side}{_position(p)}", "_bucket_n")
        for p in points.values()
        for side in ("floor", "ceil")
    ]
    # One row per wanted bucket: how many values lie before it, and how many in all.
    markers = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_bucket_n"))
        .withColumns(
            {
                "_before": F.coalesce(
                    F.sum("_bucket_n").over(_earlier(keys, "_bucket")), F.lit(0)
                ),
                "_total": F.sum("_bucket_n").over(Window.partitionBy(*keys)),
            }
        )
        .where(" OR ".join(wanted))
        .selectExpr(*keys, "_bucket", "cast(null AS bigint) AS _value", "_before AS _n", "_total")
    )
    # The marker sorts first in its bucket, so running counts start at its offset.
    in_bucket = _earlier([*keys, "_bucket"], "_value")
    opened = (
        counted.withColumn("_total", F.lit(None).cast("bigint"))
        .unionByName(markers)
        .withColumns(
            {"_before": F.sum("_n").over(in_bucket), "_total": F.first("_total").over(in_bucket)}
        )
        .where(F.col("_total").isNotNull())
    )
    picks, results = [], []
    for name, point in points.items():
        position = _position(point)
        for side in ("floor", "ceil"):
            held = _holds(f"{side}{position}", "_n")
            picks.append(F.expr(f"max(CASE WHEN {held} THEN _value END) AS _{side}_{name}"))
        share = f"({position} - floor{position})"
        results.append(f"_floor_{name} * (1 - {share}) + _ceil_{name} * {share} AS {name}")
    return (
        opened.groupBy(*keys)
        .agg(F.max("_total").alias("_total"), *picks)
        .selectExpr(*keys, *results)
    )


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """The same result from the built-in aggregate: one shuffle, for bounded groups only."""
    return df.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(float(p))).alias(name) for name, p in points.items()]
    )
