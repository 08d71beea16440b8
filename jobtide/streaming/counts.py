"""Row counts of streams, micro-batch by micro-batch, in the run log."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from jobtide.operators.jobs import latest_per_key
from jobtide.sinks.runlog import append_run_log, run_record
from jobtide.sinks.store import Store

#: What the name of a stream's counter and the run id of its records begin with.
COUNTER = "rows_of_"
RUN_ID = "stream"


def counted(stream: DataFrame, table: str) -> DataFrame:
    """The stream with a counter of the rows that each micro-batch hands to the sink of ``table``.

    The counter is part of the micro-batch's own job. A sink that upserts may store fewer rows.
    A stage that runs again after a lost executor may be counted twice, as with any observed metric.
    """
    return stream.observe(f"{COUNTER}{table}", F.count(F.lit(1)).alias("rows"))


class BatchLog(StreamingQueryListener):
    """Appends a record to the run log for every micro-batch of a counted stream.

    Spark reports a micro-batch when it is committed, so one that failed and runs again is one record. The run id
    consists of the query's id, which outlives restarts, and the batch number. A driver lost between the commit and
    the report leaves that micro-batch without a record.
    """

    def __init__(self, store: Store, table: str = "pipeline_runs", environment: str = "development"):
        self.store, self.table, self.environment = store, table, environment
        self._ended = threading.Condition()
        self._runs: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        done = event.progress
        rows = {
            name.removeprefix(COUNTER): row["rows"]
            for name, row in done.observedMetrics.items()
            if name.startswith(COUNTER)
        }
        if not rows:
            return
        start = datetime.strptime(done.timestamp, "%Y-%m-%dT%H:%M:%S.%fZ")
        record = run_record(
            run_id=f"{RUN_ID}-{done.id}-{done.batchId}",
            status="completed",
            start_time=start,
            end_time=start + timedelta(milliseconds=done.batchDuration),
            records_processed=rows,
            tables_updated=[table for table, n in rows.items() if n],
            environment=self.environment,
            collection_window_days=0,
        )
        append_run_log(self.store, record, self.table)

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._runs.add(str(event.runId))
            self._ended.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Return when all micro-batches of a query that has ended are in the run log."""
        with self._ended:
            if not self._ended.wait_for(lambda: str(query.runId) in self._runs, seconds):
                raise TimeoutError(f"no report of the end of query {query.id} in {seconds} s")


@contextmanager
def batch_log(store: Store, **how):
    """A ``BatchLog`` that listens to the session's streams for as long as the block runs."""
    log = BatchLog(store, **how)
    store.spark.streams.addListener(log)
    try:
        yield log
    finally:
        store.spark.streams.removeListener(log)


def batch_counts(run_log: DataFrame) -> DataFrame:
    """One row per micro-batch and table of a run log: query, batch number, table and rows.

    Of several records of one micro-batch the latest counts. Records of collections are left out.
    """
    batches = latest_per_key(run_log.where(F.col("run_id").startswith(f"{RUN_ID}-")), ["run_id"], ["end_time"])
    query, batch = (F.regexp_extract("run_id", rf"^{RUN_ID}-(.+)-(\d+)$", part) for part in (1, 2))
    counts = F.explode(F.from_json("records_processed", "map<string,bigint>")).alias("table", "row_count")
    return batches.select(query.alias("query_id"), batch.cast("long").alias("batch"), counts)
