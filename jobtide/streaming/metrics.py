"""Short-window cluster metrics over a stream of node samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.metrics import window_metrics
from jobtide.sinks.store import Store
from jobtide.sinks.upsert import upsert_partitions
from jobtide.streaming.counts import counted


def stream_metrics(
    samples: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """Window metrics of a stream, the same aggregates as the batch form.

    State holds one small row per cluster and window that is open within ``lateness``, pre-aggregated per
    task before the shuffle.
    """
    timed = samples.withColumn("start_time", F.col("start_time").cast("timestamp"))
    return window_metrics(timed.withWatermark("start_time", lateness), width)


WINDOW_KEYS = ("cluster_id", "window_start")


def start_metrics(
    samples: DataFrame,
    store: Store,
    checkpoint: str,
    table: str = "job_window_metrics",
    width: str = "5 minutes",
    lateness: str = "10 minutes",
    trigger: dict | None = None,
):
    """Upsert every window that a micro-batch changed, by cluster and window; the running query.

    Windows are there from their first sample on, the last ones of the stream too. A window's rows
    supersede each other, so a replayed micro-batch gives the same table.
    """

    def absorb(batch: DataFrame, _batch_id: int) -> None:
        changed = batch.withColumn("day", F.to_date("window_start"))
        if not store.exists(table):
            store.write(changed, table, partition_by=["day"])
        else:
            upsert_partitions(store, table, changed, WINDOW_KEYS, "day")

    return (
        counted(stream_metrics(samples, width, lateness), table)
        .writeStream.outputMode("update")
        .foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
