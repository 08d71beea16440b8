"""What a log of changes says at the moments of other rows.

A join in time without range comparisons: both sides are cut into equal cells of time. What holds
when a cell opens comes from one small row for each key and cell; within a cell, changes and
moments are one sorted run. A hot key is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_SECONDS = 3600
#: Ranks of rows of one moment: what a cell opens with, changes, moments that are asked for.
_OPENING, _CHANGE, _ASKED = 0, 1, 2

Fold = Callable[[str], Column]


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _scanned(
    points: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    held: Sequence[str],
    in_cell: Fold,
    running: Fold,
    cell_seconds: int,
) -> DataFrame:
    """Rows ``_row, *held`` of all points; ``changes`` are ``*keys, _time, _order, *held``.

    ``in_cell`` sums a cell's changes up, in any order; ``running`` folds what comes before, in time order.
    """
    width = cell_seconds * 1_000_000
    keyed = [F.col(k) for k in keys]
    changed = changes.withColumn("_cell", F.expr(f"_time div {width}L"))
    asked = points.select(
        *keyed, F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("_row"), _micros(at).alias("_time")
    ).withColumn("_cell", F.expr(f"_time div {width}L"))
    cells = changed.groupBy(*keys, "_cell").agg(*(in_cell(h).alias(h) for h in held))
    wanted = asked.groupBy(*keys, "_cell").agg(F.lit(True).alias("_asked"))
    both = cells.unionByName(wanted, allowMissingColumns=True).groupBy(*keys, "_cell")
    both = both.agg(*(F.first(h, ignorenulls=True).alias(h) for h in held), F.max("_asked").alias("_asked"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    opening = both.select(*keyed, "_cell", "_asked", *(running(h).over(before).alias(h) for h in held)).where("_asked")
    rows = (
        opening.drop("_asked")
        .withColumn("_rank", F.lit(_OPENING))
        .unionByName(changed.withColumn("_rank", F.lit(_CHANGE)), allowMissingColumns=True)
        .unionByName(asked.withColumn("_rank", F.lit(_ASKED)), allowMissingColumns=True)
    )
    along = (
        Window.partitionBy(*keys, "_cell")
        .orderBy((F.col("_rank") != _OPENING), "_time", "_rank", "_order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = rows.select("_rank", "_row", *(running(h).over(along).alias(h) for h in held))
    return found.where(F.col("_rank") == _ASKED)


def value_at(
    points: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    changed_at: str,
    values: Sequence[str],
    tie_break: Sequence[str] = (),
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """``points`` with the ``values`` of their key's latest change that is not later than ``at``.

    Of changes of one moment the largest by ``tie_break`` counts. Values are null where no change is that early.
    Null keys equal each other. A moment that is null has no values. New columns replace those of the same name.
    """
    log = changes.where(F.col(changed_at).isNotNull()).select(
        *keys,
        _micros(changed_at).alias("_time"),
        F.struct(changed_at, *tie_break).alias("_order"),
        F.struct(*values).alias("_value"),
    )
    latest = F.max_by("_value", "_order")
    found = _scanned(
        points, log, keys, at, ["_value"], lambda _: latest, lambda h: F.last(h, ignorenulls=True), cell_seconds
    )
    kept = [c for c in points.columns if c not in values]
    return found.select(*(F.col("_row")[c].alias(c) for c in kept), *(F.col("_value")[v].alias(v) for v in values))


def sums_at(
    points: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    changed_at: str,
    values: Mapping[str, Column],
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """``points`` with the sums of ``values`` over their key's changes that are not later than ``at``.

    A sum over no change is null. Null keys equal each other. New columns replace those of the same name.
    """
    log = changes.where(F.col(changed_at).isNotNull()).select(
        *keys,
        _micros(changed_at).alias("_time"),
        F.lit(None).cast("int").alias("_order"),
        *(c.alias(f"_sum_{name}") for name, c in values.items()),
    )
    held = [f"_sum_{name}" for name in values]
    found = _scanned(points, log, keys, at, held, F.sum, F.sum, cell_seconds)
    kept = [c for c in points.columns if c not in values]
    return found.select(
        *(F.col("_row")[c].alias(c) for c in kept), *(F.col(f"_sum_{name}").alias(name) for name in values)
    )
