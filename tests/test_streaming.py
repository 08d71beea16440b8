import random
from datetime import date, timedelta

import pytest
from conftest import NOW, SF
from pyspark.sql import functions as F

from jobtide.operators.metrics import window_metrics
from jobtide.sinks import upsert
from jobtide.sinks.runlog import run_log_rows, run_record
from jobtide.sinks.store import Store, shared_folder
from jobtide.sources import testdata as td
from jobtide.streaming.cooldown import start_cooldown
from jobtide.streaming.counts import batch_counts, batch_log
from jobtide.streaming.metrics import start_metrics
from jobtide.streaming.runs import start_runs

CANDIDATE = "alert_type string, workspace_id string, job_id string, created_at timestamp"


def feed(spark, frames, tmp_path):
    """Write frames as files of rising age and read them one file per micro-batch."""
    import os
    import time

    place = str(tmp_path / "feed")
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(place)
        stamp = time.time() - 1000 + i
        for f in os.listdir(place):
            path = os.path.join(place, f)
            if f.endswith(".parquet") and os.path.getmtime(path) > time.time() - 500:
                os.utime(path, (stamp, stamp))
    return (
        spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(place)
    )


def test_metrics_stream_equals_batch(spark, tmp_path):
    events = td.table(spark, SF, "events")
    parts = [events.where(f"ts >= '2024-01-{a:02d}' AND ts < '2024-02-{b:02d}' AND ts < '2024-01-{c:02d}'")
             for a, b, c in ((1, 1, 10), (10, 1, 20))] + [events.where("ts >= '2024-01-20'")]
    stream = td.event_samples(feed(spark, parts, tmp_path))
    store = Store(spark, folder=str(tmp_path / "store"))
    start_metrics(stream, store, str(tmp_path / "cp"), lateness="1 day").awaitTermination()
    cols = ["cluster_id", "window_start", "metric_points"]
    got = store.read("job_window_metrics").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    want = window_metrics(td.node_samples(spark, SF))
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_run_feed_keeps_late_final_states(spark, slices, tmp_path):
    """A slice of 400 minutes, one first seen late, and an old state that comes again."""
    frames = [
        slices(("j1", "long", 2, 1, None)),
        slices(("j1", "other", 1, 1, "SUCCESS")),
        slices(("j1", "long", 2, 400, "FAILED")),
        slices(("j1", "unseen", 20, 3, "SUCCESS"), ("j1", "long", 2, 1, None)),
    ]
    store = Store(spark, folder=shared_folder(spark))
    start_runs(feed(spark, frames, tmp_path), store, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.run_id, r.result_state) for r in store.read("job_runs").collect())
    assert got == [("long", "FAILED"), ("other", "SUCCESS"), ("unseen", "SUCCESS")]


def test_run_feed_drops_repeats_and_takes_changes(spark, slices, tmp_path):
    first = slices(("j1", "a", 2, 5, None), ("j1", "b", 2, 5, "SUCCESS"), ("j1", "b", 2, 5, "SUCCESS"))
    second = slices(("j1", "a", 2, 9, "FAILED"), ("j1", "b", 2, 5, "SUCCESS"), ("j1", "c", 1.99, 1, "SUCCESS"))
    stream = feed(spark, [first, second], tmp_path)
    store = Store(spark, folder=shared_folder(spark))
    start_runs(stream, store, str(tmp_path / "cp")).awaitTermination()
    got = {r.run_id: (r.result_state, r.duration_ms) for r in store.read("job_runs").collect()}
    assert got == {"a": ("FAILED", 540_000), "b": ("SUCCESS", 300_000), "c": ("SUCCESS", 60_000)}
    assert store.read("job_runs").count() == 3


def greedy(rows, minutes):
    sent, last = set(), {}
    for kind, ws, job, at in sorted(rows, key=lambda r: r[3]):
        if job not in last or at - last[job] >= timedelta(minutes=minutes):
            sent.add((job, at))
            last[job] = at
    return sent


@pytest.mark.parametrize("minutes", [30, 600])
def test_cooldown_is_greedy_across_batches(spark, tmp_path, minutes):
    rng = random.Random(minutes)
    rows = []
    for _ in range(500):
        job = "hot" if rng.random() < 0.4 else f"j{rng.randrange(6)}"
        rows.append(("job_failure", "w", job, NOW + timedelta(minutes=rng.randrange(4000))))
    rows.sort(key=lambda r: r[3])
    cuts = [NOW + timedelta(minutes=m) for m in (0, 1000, 2500, 5000)]
    frames = [
        spark.createDataFrame([r for r in rows if a <= r[3] < b], CANDIDATE).repartition(3)
        for a, b in zip(cuts, cuts[1:])
    ]
    out = str(tmp_path / "out")
    start_cooldown(feed(spark, frames, tmp_path), out, str(tmp_path / "cp"), minutes).awaitTermination()
    got = {(r.job_id, r.sent_at) for r in spark.read.parquet(out).collect()}
    assert got == greedy(rows, minutes)


def test_cooldown_resumes_from_its_checkpoint(spark, tmp_path):
    rows = [("t", "w", "j", NOW + timedelta(minutes=m)) for m in (0, 10, 40, 50, 80)]
    place, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, CANDIDATE).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(CANDIDATE).parquet(place)
        start_cooldown(stream, out, cp, 30).awaitTermination()
    got = sorted(r.sent_at for r in spark.read.parquet(out).collect())
    assert got == [NOW, NOW + timedelta(minutes=40), NOW + timedelta(minutes=80)]


def cooldown_state(spark, checkpoint):
    from jobtide.streaming.cooldown import STATE

    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", STATE).load(checkpoint)
    return {tuple(r.key)[2]: r.value[0] for r in state.collect()}


def test_cooldown_state_expires_and_late_candidates_stay_silent(spark, tmp_path):
    at = lambda m: NOW + timedelta(minutes=m)
    parts = [
        [("t", "w", "j", at(0)), ("t", "w", "k", at(0))],
        [("t", "w", "k", at(200))],
        # Older than k's last alert, but not too late for the watermark.
        [("t", "w", "k", at(190)), ("t", "w", "k", at(229))],
        [("t", "w", "k", at(230))],
    ]
    frames = [spark.createDataFrame(p, CANDIDATE) for p in parts]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    start_cooldown(feed(spark, frames, tmp_path), out, cp, 30, "1 hour").awaitTermination()
    got = sorted((r.job_id, r.sent_at) for r in spark.read.parquet(out).collect())
    assert got == [("j", at(0)), ("k", at(0)), ("k", at(200)), ("k", at(230))]
    state = cooldown_state(spark, cp)
    # The watermark has passed the end of j's silence long ago; k's goes on.
    assert set(state) == {"k"}


def test_streamed_failures_equal_the_batch_after_a_restart(spark, tmp_path):
    from jobtide.operators.alerts import failure_alerts
    from jobtide.streaming.alerts import start_failure_alerts

    events = td.table(spark, SF, "events")
    place, store = str(tmp_path / "in"), Store(spark, folder=shared_folder(spark))
    for k, bound in enumerate(("ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'")):
        events.where(bound).coalesce(1).write.mode("append").parquet(place)
        if k == 1:
            # Delivered again, as after a failure of the source.
            events.where("ts >= '2024-01-10' AND ts < '2024-01-11'").coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)
        start_failure_alerts(
            td.event_slices(stream), td.event_changes(stream), store, str(tmp_path / "cp"), lateness="20 days", names_from="40 days"
        ).awaitTermination()
    got = store.read("failure_alerts")
    runs = td.event_slices(events)
    want = failure_alerts(runs, None, at_event_time=True, changes=td.event_changes(events), tie_break=["change_id"])
    names = ["id", "job_name", "title", "message", "severity"]
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect()) and got.count() > 50
    assert got.where("change_time is not null").count() > 10


def test_run_log_counts_every_micro_batch_over_a_restart(spark, slices, tmp_path):
    """Rows handed to an upsert, repeats too, and sent alerts; a query without a counter leaves no record."""
    store = Store(spark, folder=shared_folder(spark))
    parts = [
        slices(("j1", "a", 3, 5, "SUCCESS"), ("j1", "b", 3, 5, "SUCCESS"), ("j1", "b", 3, 5, "SUCCESS")),
        slices(("j1", "c", 2, 5, "SUCCESS")),
        slices(("j1", "d", 1, 5, "SUCCESS"), ("j1", "a", 3, 5, "SUCCESS")),
    ]
    with batch_log(store) as log:
        for some in (parts[:2], parts[2:]):
            stream = feed(spark, some, tmp_path)
            query = start_runs(stream, store, str(tmp_path / "cp"))
            query.awaitTermination()
            log.wait_for(query)
        plain = stream.writeStream.format("noop").trigger(availableNow=True)
        query = plain.option("checkpointLocation", str(tmp_path / "cp-plain")).start()
        query.awaitTermination()
        log.wait_for(query)
    counts = batch_counts(store.read("pipeline_runs"))
    assert sorted((r.batch, r.table, r.row_count) for r in counts.collect() if r.row_count) == [
        (0, "job_runs", 3), (1, "job_runs", 1), (2, "job_runs", 2),
    ]
    assert counts.select("query_id").distinct().count() == 1
    assert store.read("job_runs").count() == 4


def test_batch_that_ran_again_counts_once(spark):
    rows = [
        run_record(
            run_id="stream-q-7", status="completed", start_time=NOW, end_time=NOW + timedelta(minutes=m),
            records_processed={"t": n},
        )
        for m, n in ((1, 5), (2, 6))
    ]
    rows.append(run_record(run_id="c", status="completed", start_time=NOW, end_time=NOW, records_processed={"t": 9}))
    assert [tuple(r) for r in batch_counts(run_log_rows(spark, rows)).collect()] == [("q", 7, "t", 6)]


@pytest.mark.parametrize("most", [1, 366])
def test_touched_partitions_by_name_or_by_join(spark, monkeypatch, most):
    """Both ways replace the same rows, null partitions among them."""
    monkeypatch.setattr(upsert, "NAMED_PARTITIONS", most)
    store = Store(spark, folder=shared_folder(spark))
    schema = "k int, v int, day date"
    old = [(1, 0, date(2024, 1, 1)), (2, 0, date(2024, 1, 2)), (3, 0, date(2024, 1, 3)), (4, 0, None)]
    store.write(spark.createDataFrame(old, schema), "t", partition_by=["day"])
    new = [(1, 1, date(2024, 1, 1)), (3, 1, date(2024, 1, 3)), (4, 1, None), (5, 1, date(2024, 1, 5))]
    upsert.upsert_partitions(store, "t", spark.createDataFrame(new, schema), ["k"], "day")
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, 1), (2, 0), (3, 1), (4, 1), (5, 1)]
    assert upsert.upsert_partitions(store, "t", spark.createDataFrame([], schema), ["k"], "day") == 0


def test_micro_batches_grow_with_the_table_not_their_number(spark, tmp_path):
    """A table of several files gives as many micro-batches as one of one file: one for each quarter."""
    from checks.queries import _event_stream

    events = td.table(spark, SF, "events")
    for files in (1, 8):
        sf = str(tmp_path / f"sf-{files}")
        events.repartition(files).write.parquet(f"{sf}/events.parquet")
        place = str(tmp_path / f"stream-{files}")
        for quarters, batches in ((range(2), 2), (range(2, 4), 2)):
            stream = _event_stream(spark, sf, place, quarters).writeStream.format("noop")
            stream = stream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
            stream.awaitTermination()
            assert sum(p["numInputRows"] > 0 for p in stream.recentProgress) == batches
        assert len({r[0] for r in spark.read.parquet(f"{place}/events").select("_metadata.file_path").distinct().collect()}) >= 4
