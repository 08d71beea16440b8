"""Stateful alert cooldown: send, then stay silent for a while, per alert subject."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobtide.operators.limits import ALERT_SUBJECT, COOLDOWN_MINUTES
from jobtide.sinks.store import session_setting
from jobtide.streaming.counts import counted

# The processor below reaches the Python workers whole: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "alert_type STRING, workspace_id STRING, job_id STRING, second BIGINT"
STATE = "last_sent"
#: Processors with state of their own need the store that keeps several states for a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Keeps the second of a subject's last alert until a timer says that its silence is over.

    A candidate is sent if the last alert is at least the quiet period old; one from before the last
    alert, which came late, is not. Without a new candidate the subject's state is gone once the watermark
    passes the end of the silence.
    """

    def __init__(self, minutes: int):
        self.quiet = minutes * 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last_sent = handle.getValueState(STATE, "second BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Candidates arrive in any order; distinct seconds bound what is kept here.
        parts = [np.array([], dtype="int64"), *(c["second"].to_numpy() for c in rows)]
        seconds = np.unique(np.concatenate(parts))
        last = int(self.last_sent.get()[0]) if self.last_sent.exists() else None
        sent = []
        # The next alert is the first candidate once the last one's silence is over.
        i = 0 if last is None else int(np.searchsorted(seconds, last + self.quiet))
        while i < len(seconds):
            last = int(seconds[i])
            sent.append(last)
            i = int(np.searchsorted(seconds, last + self.quiet))
        if sent:
            self.last_sent.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.quiet) * 1000)
            yield pd.DataFrame([(*key, s) for s in sent], columns=[*ALERT_SUBJECT, "second"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last_sent.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_cooldown(
    candidates: DataFrame, minutes: int = COOLDOWN_MINUTES, lateness: str = "1 hour"
) -> DataFrame:
    """Alerts to send from a stream of candidates (subject columns, ``created_at``).

    Alert ids have whole seconds, so candidates of one subject and second are one
    alert: repeats are dropped first, on a key that spreads a hot subject over all
    tasks. The decision itself is sequential per subject and keeps one number, the
    last sent second, which expires with the cooldown.
    """
    timed = (
        candidates.select(*ALERT_SUBJECT, F.col("created_at").cast("timestamp"))
        .withColumn("created_at", F.date_trunc("second", "created_at"))
        .withWatermark("created_at", lateness)
        .dropDuplicatesWithinWatermark([*ALERT_SUBJECT, "created_at"])
        .withColumn("second", F.unix_seconds("created_at"))
    )
    sent = timed.groupBy(*ALERT_SUBJECT).transformWithStateInPandas(
        Cooldown(minutes), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
    return sent.select(*ALERT_SUBJECT, F.timestamp_seconds("second").alias("sent_at"))


def start_cooldown(
    candidates: DataFrame,
    output: str,
    checkpoint: str,
    minutes: int = COOLDOWN_MINUTES,
    lateness: str = "1 hour",
    trigger: dict | None = None,
):
    """Write the alerts to send to parquet files, exactly once; the running query."""
    writer = (
        counted(stream_cooldown(candidates, minutes, lateness), "alerts_sent")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # A query keeps the settings that it was started with.
    with session_setting(candidates.sparkSession, "spark.sql.streaming.stateStore.providerClass", STATE_STORE):
        return writer.start()
