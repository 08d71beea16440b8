"""Insert-or-replace by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from jobtide.functions.clock import AsOf, days_before, moment, within_days
from jobtide.operators.jobs import latest_per_key
from jobtide.schemas import SLICE_KEYS
from jobtide.sinks.store import Store


#: What tells versions of one slice apart, the later one last.
VERSION = ("period_end_time", "collected_at")
#: Partitions that the scan of the old rows is given by name; more of them are found by a join.
NAMED_PARTITIONS = 366


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` added or put in place of equal keys.

    ``new`` must hold one row per key. Null keys equal each other. Columns only one
    side has become null.
    """
    marks = new.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
    same = reduce(and_, (existing[k].eqNullSafe(marks[f"_new_{k}"]) for k in keys))
    untouched = existing.join(marks, same, "left_anti")
    return untouched.unionByName(new, allowMissingColumns=True)


def upsert_copy(
    store: Store, table: str, new: DataFrame, keys: Sequence[str], target: str
) -> int:
    """Upsert an unpartitioned table into a table of another name, which readers move to.

    A plain file table cannot replace itself while it is being read.
    """
    return store.write(upserted(store.read(table), new, keys), target)


def _one_of(column: str, values: Sequence) -> Column:
    """Whether a column has one of the values, null among them; a filter that prunes partitions."""
    found = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False))
    return found | F.col(column).isNull() if None in values else found


def _touched_rows(old: DataFrame, touched: DataFrame, partition: str) -> DataFrame:
    """Rows of any number of partitions: first and last prune the scan, a semi join leaves out those between."""
    first, last = touched.agg(F.min(partition), F.max(partition)).first()
    between = F.col(partition).between(F.lit(first), F.lit(last))
    old = old.where(F.coalesce(between, F.col(partition).isNull()))
    dates = touched.select(F.col(partition).alias("_date"))
    return old.join(dates, old[partition].eqNullSafe(dates["_date"]), "left_semi")


def upsert_partitions(
    store: Store,
    table: str,
    new: DataFrame,
    keys: Sequence[str],
    partition: str,
    version: Sequence[str] = (),
) -> int:
    """Upsert ``new`` into a stored, date-partitioned table, rewriting touched dates only.

    ``partition`` must follow from ``keys``, so that both versions of a row share a
    partition. ``new`` is computed once, into the workspace's memory and disk, and only the
    partitions it has rows for are read. With ``version`` columns the later of both versions of a row
    stays, by these columns in order, nulls first; of equal ones the new row.
    """
    kept = new.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touched = kept.select(partition).distinct()
        named = [row[0] for row in touched.limit(NAMED_PARTITIONS + 1).collect()]
        if not named:
            return 0
        if len(named) <= NAMED_PARTITIONS:
            old = store.read(table).where(_one_of(partition, named))
        else:
            old = _touched_rows(store.read(table), touched, partition)
        if not version:
            return store.replace_partitions(upserted(old, kept, keys), table, [partition])
        both = old.withColumn("_new", F.lit(0)).unionByName(
            kept.withColumn("_new", F.lit(1)), allowMissingColumns=True
        )
        merged = latest_per_key(both, keys, [*version, "_new"]).drop("_new")
        return store.replace_partitions(merged, table, [partition])
    finally:
        kept.unpersist()


def high_water_mark(
    stored: DataFrame,
    column: str = "period_start_time",
    partition: str | None = None,
    as_of: AsOf = None,
) -> str | None:
    """Largest stored ``column`` value up to ``as_of``, as text in session time; None without one.

    A value ahead of ``as_of`` is no mark: it would keep all later rows out. Where ``partition`` is
    the date of ``column``, only the newest partition up to then is read.
    """
    if as_of is not None:
        stored = stored.where(F.col(column) <= moment(as_of, stored.schema[column].dataType.simpleString()))
    if partition:
        if as_of is not None:
            stored = stored.where(F.col(partition) <= moment(as_of).cast("date"))
        newest = stored.agg(F.max(partition)).first()[0]
        stored = stored.where(F.col(partition) == F.lit(newest))
    return stored.agg(F.max(column).cast("string")).first()[0]


def newer_slices(
    slices: DataFrame,
    mark: str | None,
    overlap_days: int = 0,
    column: str = "period_start_time",
) -> DataFrame:
    """Slices from the mark on, reaching back ``overlap_days`` for late changes.

    ``column`` is what the mark was taken of: the time of the last change if the source has
    one, which leaves no change out, or the start time.
    """
    if mark is None:
        return slices
    return slices.where(F.col(column) >= days_before(slices, column, mark, overlap_days))


def dated(runs: DataFrame) -> DataFrame:
    """Run slices with the ``run_date`` their table is partitioned by."""
    return runs.withColumn("run_date", F.to_date("period_start_time"))


def upsert_runs(
    store: Store, runs: DataFrame, table: str = "job_runs", version: Sequence[str] = ()
) -> int:
    """Upsert run slices by slice key into a run table partitioned by ``run_date``.

    The first call creates the table. Returns the rows of the rewritten dates.
    """
    if not store.exists(table):
        return store.write(dated(runs), table, partition_by=["run_date"])
    return upsert_partitions(store, table, dated(runs), SLICE_KEYS, "run_date", version)


def stored_runs(store: Store, as_of: AsOf, days: int, table: str = "job_runs") -> DataFrame:
    """The last ``days`` of a date-partitioned run table; older partitions are pruned."""
    runs = store.read(table)
    first_date = F.date_sub(moment(as_of).cast("date"), days)
    return runs.where(
        (F.col("run_date") >= first_date) & within_days(runs, "period_start_time", as_of, days)
    ).drop("run_date")
