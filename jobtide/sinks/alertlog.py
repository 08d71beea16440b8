"""The alert history, and what it says about alerts that were sent before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import AsOf, moment
from jobtide.operators.alerts import RULES, AlertRule
from jobtide.operators.limits import ALERT_SUBJECT, rate_limited
from jobtide.operators.routing import alert_history
from jobtide.sinks.store import Store

TABLE = "job_alerts"
#: Kinds that are about a state of a job, not about one event: they are news again the next day.
STATES = ("health_score_low", "performance_anomaly")


def alert_identity() -> Column:
    """What an alert is about: its id without the second, and for states of a job the day."""
    base = F.regexp_replace("id", "_-?[0-9]+$", "")
    day = F.when(F.col("alert_type").isin(*STATES), F.to_date("created_at").cast("string"))
    return F.concat_ws("@", base, day)


def _until(history: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """History rows of the last ``days`` dates up to ``as_of``; older partitions are not read."""
    now = moment(as_of)
    recent = F.col("alert_date") >= F.date_sub(now.cast("date"), days)
    return history.where(recent & (F.col("alert_date") <= now.cast("date")) & (F.col("created_at") <= now))


def sent_before(history: DataFrame, as_of: AsOf, cooldown_minutes: int) -> DataFrame:
    """Alerts sent up to ``as_of`` that may still keep others from being sent."""
    recent = _until(history, as_of, 1 + cooldown_minutes // 1440)
    return recent.where("suppressed_by is null").select("id", *ALERT_SUBJECT, "created_at")


def without_known(alerts: DataFrame, history: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """``alerts`` with ``suppressed_by``, which is ``known`` where the last ``days`` of the history have it."""
    held = _until(history, as_of, days).select(alert_identity().alias("_held")).distinct()
    marked = alerts.withColumn("_identity", alert_identity()).join(held, F.col("_identity") == F.col("_held"), "left")
    known = F.when(F.col("_held").isNotNull(), F.lit("known"))
    return marked.select(*alerts.columns, known.alias("suppressed_by"))


def marked_alerts(
    store: Store,
    alerts: DataFrame,
    as_of: AsOf,
    days: int = 31,
    limits: Mapping[str, int] | None = None,
    table: str = TABLE,
) -> DataFrame:
    """``alerts`` with ``suppressed_by``: what the history knows, and what the limits hold back.

    An alert that the history has is ``known`` and not sent again, whether it was sent then or held back. ``limits``
    are arguments of ``rate_limited``; alerts that earlier collections sent count for them. No limits if None.
    """
    history = store.read(table) if store.exists(table) else None
    if history is not None:
        alerts = without_known(alerts, history, as_of, days)
    if limits is None:
        return alerts if history is not None else alerts.withColumn("suppressed_by", F.lit(None).cast("string"))
    before = None if history is None else sent_before(history, as_of, limits["cooldown_minutes"])
    return rate_limited(alerts, tie_break=["id"], sent_before=before, **limits)


def append_history(
    store: Store,
    marked: DataFrame,
    channels: Sequence[str],
    rules: Mapping[str, AlertRule] = RULES,
    table: str = TABLE,
) -> int:
    """Append the alerts that the history lacks, by date; their number.

    The history is the memory of the limits, so there is no second table to keep in step with it, and a
    collection that is repeated finds its own alerts and adds nothing.
    """
    fresh = marked.where("suppressed_by is null or suppressed_by <> 'known'")
    if fresh.isEmpty():
        return 0
    dated = alert_history(fresh, channels, rules).withColumn("alert_date", F.to_date("created_at"))
    return store.write(dated, table, mode="append", partition_by=["alert_date"])
