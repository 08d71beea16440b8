"""Failure alerts of a stream of run slices, named from a stream of metadata changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.alert_text import display_name
from jobtide.operators.alerts import RULES, AlertRule, failure_rows
from jobtide.operators.jobs import latest_per_key
from jobtide.schemas import JOB_KEYS
from jobtide.sinks.store import Store
from jobtide.sinks.upsert import upsert_partitions
from jobtide.streaming.counts import counted

#: Which of two versions of an alert is the later: that of the later change.
VERSION = ("change_time", "change_id")


def named_failures(slices: DataFrame, changes: DataFrame, lateness: str, names_from: str) -> DataFrame:
    """Failed slices, each at once without a name and then with the name of every change that is not later than it.

    A slice and a change meet whichever comes first. Both streams keep what is not older than their
    watermarks and ``names_from``, the time that a name is looked for before a slice's start.
    """
    failed = slices.where(F.col("result_state") == "FAILED").select(
        *JOB_KEYS, "run_id", F.col("period_start_time").cast("timestamp").alias("period_start_time"), "state_message"
    )
    log = changes.select(
        *(F.col(k).alias(f"_{k}") for k in JOB_KEYS),
        F.col("change_time").cast("timestamp").alias("change_time"),
        F.col("change_id").cast("long").alias("change_id"),
        "name",
    )
    started = failed.withWatermark("period_start_time", lateness)
    same = [F.col(k) == F.col(f"_{k}") for k in JOB_KEYS]
    before = F.col("change_time") >= F.col("period_start_time") - F.expr(f"INTERVAL {names_from}")
    named = started.join(
        log.withWatermark("change_time", lateness),
        [*same, F.col("change_time") <= F.col("period_start_time"), before],
    ).select(*failed.columns, *VERSION, "name")
    unnamed = started.select(
        *failed.columns,
        F.lit(None).cast("timestamp").alias("change_time"),
        F.lit(None).cast("long").alias("change_id"),
        F.lit(None).cast("string").alias("name"),
    )
    return unnamed.unionByName(named)


def start_failure_alerts(
    slices: DataFrame,
    changes: DataFrame,
    store: Store,
    checkpoint: str,
    table: str = "failure_alerts",
    rule: AlertRule = RULES["job_failure"],
    lateness: str = "1 hour",
    names_from: str = "30 days",
    trigger: dict | None = None,
):
    """Upsert the alerts by id into a table by date; the running query.

    ``changes`` need a ``change_id`` that orders those of one moment. An alert is there with its first micro-batch,
    named by its job id; of all names that reach it the latest stays. Versions of an alert supersede each other by their
    change, so replays and restarts give the same table.
    """

    def absorb(batch: DataFrame, _batch_id: int) -> None:
        name = display_name(F.col("name"), F.col("job_id"))
        alerts = failure_rows(batch.withColumn("_name", name), rule, F.col("period_start_time"), VERSION)
        fresh = latest_per_key(alerts, ["id"], VERSION).withColumn("alert_date", F.to_date("created_at"))
        if not store.exists(table):
            store.write(fresh, table, partition_by=["alert_date"])
        else:
            upsert_partitions(store, table, fresh, ["id"], "alert_date", VERSION)

    return (
        counted(named_failures(slices, changes, lateness, names_from), table)
        .writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
