"""Run feed: a stream of slices, projected and upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobtide.functions.clock import AsOf
from jobtide.operators.jobs import latest_per_key
from jobtide.operators.runs import project_runs
from jobtide.schemas import SLICE_KEYS
from jobtide.sinks.store import Store
from jobtide.sinks.upsert import VERSION, upsert_runs
from jobtide.streaming.counts import counted


def start_runs(
    slices: DataFrame,
    store: Store,
    checkpoint: str,
    table: str = "job_runs",
    as_of: AsOf = None,
    trigger: dict | None = None,
):
    """Upsert the feed into the date-partitioned run table; the running query.

    No event-time deduplication comes before the upsert: it would drop the final state of every slice
    longer than its watermark. Each micro-batch is reduced to one row per slice; the stored row stays
    if its version is later, so repeats, replays and old states that come late change nothing.
    """

    def absorb(batch: DataFrame, _batch_id: int) -> None:
        upsert_runs(store, latest_per_key(batch, SLICE_KEYS, VERSION), table, VERSION)

    return (
        counted(project_runs(slices, as_of), table)
        .writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
