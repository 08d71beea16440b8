"""The pipeline's own run log."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from jobtide.schemas import TABLES
from jobtide.sinks.store import Store
from jobtide.sources.tables import local_rows


def run_record(
    *,
    run_id: str,
    status: str,
    start_time: datetime,
    end_time: datetime,
    records_processed: Mapping[str, int] | None = None,
    tables_updated: Sequence[str] = (),
    alerts_sent: Mapping[str, int] | None = None,
    errors: Sequence[str] = (),
    environment: str = "development",
    collection_window_days: int = 30,
) -> dict:
    """One run-log record; maps and lists become JSON text, duration whole seconds."""
    return {
        "run_id": run_id,
        "status": status,
        "start_time": start_time,
        "end_time": end_time,
        "duration_seconds": int((end_time - start_time).total_seconds()),
        "records_processed": json.dumps(dict(records_processed or {})),
        "tables_updated": len(tables_updated),
        "alerts_sent": json.dumps(dict(alerts_sent or {})),
        "errors": json.dumps(list(errors)),
        "environment": environment,
        "collection_window_days": collection_window_days,
    }


def run_log_rows(spark: SparkSession, records: Sequence[Mapping]) -> DataFrame:
    return local_rows(spark, records, TABLES["pipeline_runs"])


def append_run_log(store: Store, record: Mapping, table: str = "pipeline_runs") -> None:
    """Append one record to the run log."""
    store.write(run_log_rows(store.spark, [record]), table, mode="append")
