"""Rate limits on alert candidates."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# The function below reaches the Python workers whole: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALERT_SUBJECT = ("alert_type", "workspace_id", "job_id")

# Default limits.
COOLDOWN_MINUTES = 30
MAX_PER_HOUR = 10
MAX_PER_DAY = 50


#: Buckets in which an hour or day is ranked before the survivors are ranked together.
RANK_BUCKETS = 1024


def _borders(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where a subject's rows begin, by comparing every key column with itself one row on."""
    differs = np.zeros(max(0, len(batch) - 1), bool)
    for k in range(n_keys):
        one, next_ = batch.column(k).slice(0, len(batch) - 1), batch.column(k).slice(1)
        unequal = pc.fill_null(pc.not_equal(one, next_), False)
        null = pc.not_equal(one.is_null(), next_.is_null())
        differs |= pc.or_(unequal, null).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(differs) + 1, len(batch)] if len(batch) else np.zeros(1, np.int64)


def _greedy(width: int, n_keys: int):
    """For ``mapInArrow`` over (subject, second, first, carried) in order: the rows at which an alert is sent.

    The next alert is the first candidate once the last one's silence is over; carried rows, which were sent earlier,
    come first in their subject and are not repeated. One number goes from batch to batch, whatever the
    number of candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject, last = None, None
        for batch in batches:
            seconds = batch.column(n_keys).to_numpy()
            carried = batch.column(n_keys + 2).to_numpy(zero_copy_only=False)
            borders, picked = _borders(batch, n_keys), []
            for at, stop in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                own = tuple(batch.column(k)[at].as_py() for k in range(n_keys))
                if own != subject:
                    subject, last = own, None
                known = int(carried[at:stop].sum())
                if known:
                    last = int(seconds[at : at + known].max())
                    at += known
                times = seconds[at:stop]
                i = 0 if last is None else int(np.searchsorted(times, last + width))
                while i < len(times):
                    last = int(times[i])
                    picked.append(at + i)
                    i = int(np.searchsorted(times, last + width))
            yield batch.take(pa.array(picked, pa.int64())).select(range(n_keys + 2))

    return run


def _second() -> Column:
    return F.unix_seconds(F.col("created_at").cast("timestamp"))


def after_quiet_period(
    alerts: DataFrame,
    minutes: int = COOLDOWN_MINUTES,
    tie_break: Sequence[str] = (),
    subject: Sequence[str] = ALERT_SUBJECT,
    sent_before: DataFrame | None = None,
) -> DataFrame:
    """``alerts`` with ``suppressed_by``: null for those sent, ``cooldown`` for the others.

    An alert is sent if its subject's last sent one is at least ``minutes`` old, to the second; of one
    second the first by time and ``tie_break``. This is what the stream form does. ``sent_before`` holds alerts
    that were sent earlier: a subject is silent after the last of them, also towards candidates from before it.
    Alerts that come with ``suppressed_by`` keep it and have no part in this. Candidates become
    distinct seconds first; a subject's seconds are then one sorted run in one task, read in batches.
    """
    if "suppressed_by" not in alerts.columns:
        alerts = alerts.withColumn("suppressed_by", F.lit(None).cast("string"))
    if minutes <= 0:
        return alerts
    subject = list(subject)
    order = F.struct("created_at", *tie_break)
    firsts = (
        alerts.where("suppressed_by is null")
        .groupBy(*subject, _second().alias("_second"))
        .agg(F.min(order).alias("_first"))
        .withColumn("_carried", F.lit(False))
    )
    runs = firsts
    if sent_before is not None:
        last = sent_before.groupBy(*subject).agg(F.max(_second()).alias("_second"))
        runs = firsts.unionByName(last.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    kept = [f for f in firsts.schema if f.name != "_carried"]
    sent = (
        runs.repartition(*subject)
        .sortWithinPartitions(*subject, F.col("_carried").desc(), "_second")
        .mapInArrow(_greedy(minutes * 60, len(subject)), StructType(kept))
        .select(*(F.col(c).alias(f"_sent_{c}") for c in subject), "_first")
    )
    same = [alerts[c].eqNullSafe(sent[f"_sent_{c}"]) for c in subject]
    marked = alerts.join(sent, [*same, order.eqNullSafe(F.col("_first"))], "left")
    held = F.when(F.col("_first").isNull(), F.lit("cooldown"))
    return marked.select(
        *(c for c in alerts.columns if c != "suppressed_by"),
        F.coalesce("suppressed_by", held).alias("suppressed_by"),
    )


def first_per_period(
    alerts: DataFrame,
    unit: str,
    most: int,
    tie_break: Sequence[str] = (),
    scope: Sequence[str] = (),
    carried: str | None = None,
) -> DataFrame:
    """Mark all but the earliest ``most`` unsuppressed alerts of each clock ``unit`` (hour, day).

    A period is ranked in buckets first; only the first ``most`` of each are ranked together. Rows with a
    true ``carried`` column were sent earlier: they count before all others and are never marked.
    """
    early = [~F.col(carried)] if carried else []
    order = [*early, "created_at", *ALERT_SUBJECT, *tie_break]
    open_ = F.col("suppressed_by").isNull()
    period = [*scope, F.date_trunc(unit, "created_at"), open_]
    bucket = F.pmod(F.xxhash64("created_at", *ALERT_SUBJECT, *tie_break), F.lit(RANK_BUCKETS))
    near = Window.partitionBy(*period, bucket).orderBy(*order)
    among = F.when(F.col("_nth") <= most, F.lit(-1)).otherwise(bucket)
    last = Window.partitionBy(*period, F.when(open_, among).otherwise(bucket)).orderBy(*order)
    ranked = alerts.withColumn("_nth", F.row_number().over(near)).withColumn("_rank", F.row_number().over(last))
    late = open_ & ((F.col("_nth") > most) | (F.col("_rank") > most))
    if carried:
        late &= ~F.col(carried)
    return ranked.withColumn("suppressed_by", F.when(late, F.lit(unit)).otherwise(F.col("suppressed_by"))).drop(
        "_nth", "_rank"
    )


def rate_limited(
    candidates: DataFrame,
    cooldown_minutes: int = COOLDOWN_MINUTES,
    max_per_hour: int = MAX_PER_HOUR,
    max_per_day: int = MAX_PER_DAY,
    tie_break: Sequence[str] = (),
    scope: Sequence[str] = (),
    sent_before: DataFrame | None = None,
) -> DataFrame:
    """All candidates, with the limit that keeps each from being sent in ``suppressed_by``.

    Quiet period per subject (``cooldown``), then hourly and daily caps (``hour``, ``day``) on
    what is left. ``candidates`` need the subject columns and ``created_at``; those that come with a
    ``suppressed_by`` keep it. The caps count all alerts together; ``scope`` counts them per those
    columns. ``tie_break`` orders candidates of one subject and instant and has to tell them apart.
    ``sent_before`` are alerts, with the same columns, that earlier calls have sent: they count for the quiet
    period and, in the hours and days that are not over, for the caps.
    """
    marked = after_quiet_period(candidates, cooldown_minutes, tie_break, sent_before=sent_before)
    carried = None
    if sent_before is not None:
        carried = "_carried"
        before = sent_before.select("created_at", *ALERT_SUBJECT, *dict.fromkeys([*tie_break, *scope])).withColumn(carried, F.lit(True))
        marked = marked.withColumn(carried, F.lit(False)).unionByName(before, allowMissingColumns=True)
    marked = first_per_period(marked, "hour", max_per_hour, tie_break, scope, carried)
    marked = first_per_period(marked, "day", max_per_day, tie_break, scope, carried)
    return marked.where(~F.col(carried)).drop(carried) if carried else marked
