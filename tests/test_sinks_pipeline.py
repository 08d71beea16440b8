import json
from datetime import datetime

import pytest
from conftest import AS_OF, NOW, SF
from pyspark.sql import functions as F

from checks.queries import tidy
from jobtide.operators.baselines import job_baselines
from jobtide.operators.runs import job_runs
from jobtide.plans.pipeline import Settings, collect_incremental, collect_late, late_slices, run_collection
from jobtide.plans.reports import recent_pipeline_runs, unhealthiest_jobs
from jobtide.schemas import SLICE_KEYS, TABLES
from jobtide.sinks.runlog import append_run_log, run_record
from jobtide.sinks.store import Store, shared_folder
from jobtide.sinks.upsert import (
    high_water_mark,
    newer_slices,
    stored_runs,
    upsert_copy,
    upsert_runs,
    upserted,
)
from jobtide.sources import testdata as td
from jobtide.sources.probe import count_sources, probe_sources, require_sources
from jobtide.sources.tables import read_source, read_sources


@pytest.fixture
def store(spark):
    return Store(spark, folder=shared_folder(spark))


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark), shared_folder(spark)
    assert first.startswith(base + "/") and first != second


def test_store_needs_one_place(spark):
    with pytest.raises(ValueError):
        Store(spark)


def test_write_conforms_counts_and_overwrites(store, slices):
    runs = job_runs(slices(("j1", "a", 1, 1, "SUCCESS"), ("j1", "b", 1, 1, "FAILED")), AS_OF)
    assert store.write(runs.withColumn("duration_ms", F.lit("7")), "job_runs") == 2
    assert store.read("job_runs").schema == TABLES["job_runs"]
    assert store.write(runs.limit(1), "job_runs") == 1
    assert store.read("job_runs").count() == 1


def test_append_with_a_new_column_is_read_merged(store, slices):
    runs = job_runs(slices(("j1", "a", 1, 1, "SUCCESS")), AS_OF)
    store.write(runs, "job_runs")
    store.write(runs.withColumn("note", F.lit("x")), "job_runs", mode="append")
    got = store.read("job_runs", merge_schema=True)
    assert {r.note for r in got.collect()} == {None, "x"} and got.count() == 2


def test_empty_frames_leave_tables_alone(store, slices):
    runs = job_runs(slices(("j1", "a", 1, 1, "SUCCESS")), AS_OF)
    counts = store.write_all({"job_runs": runs, "job_metrics": None})
    assert counts == {"job_runs": 1, "job_metrics": 0}
    assert store.write_all({"job_runs": runs.where("false")}) == {"job_runs": 0}
    assert store.write_if_any(runs.where("run_id = 'none'"), "job_runs", persist=False) == 0
    assert store.read("job_runs").count() == 1
    assert not store.exists("job_metrics")


def test_database_store(spark, slices):
    store = Store(spark, database="jobtide_test")
    runs = job_runs(slices(("j1", "a", 1, 1, "SUCCESS")), AS_OF)
    assert store.write(runs, "job_runs") == 1
    assert read_source(spark, "jobtide_test.job_runs").count() == 1
    assert store.exists("job_runs") and not store.exists("nothing")
    spark.sql("DROP DATABASE jobtide_test CASCADE")


def test_database_append_and_partition_upsert(spark, slices):
    store = Store(spark, database="jobtide_upsert")
    first = job_runs(slices(("j1", "a", 3, 1, "SUCCESS"), ("j1", "b", 2, 1, None)), AS_OF)
    dated = first.withColumn("run_date", F.to_date("period_start_time"))
    store.write(dated, "job_runs", partition_by=["run_date"])
    fresh = job_runs(slices(("j1", "b", 2, 1, "FAILED"), ("j1", "c", 1, 1, "SUCCESS")), AS_OF)
    assert upsert_runs(store, fresh) == 2
    assert table_rows(store) == [("a", "SUCCESS", "2024-01-28"), ("b", "FAILED", "2024-01-29"),
                                 ("c", "SUCCESS", "2024-01-30")]
    noted = dated.where("run_id = 'a'").withColumn("note", F.lit("again"))
    assert store.write(noted, "job_runs", mode="append") == 1
    assert {(r.run_id, r.note) for r in store.read("job_runs").collect()} == {
        ("a", None), ("a", "again"), ("b", None), ("c", None)}
    spark.sql("DROP DATABASE jobtide_upsert CASCADE")


def test_upsert_replaces_adds_and_fills(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 20, "n"), ("c", 30, "n")], "k string, v int, extra string")
    got = {tuple(r) for r in upserted(old, new, ["k"]).collect()}
    assert got == {("a", 1, None), ("b", 20, "n"), ("c", 30, "n")}


def table_rows(store):
    return sorted((r.run_id, r.result_state, str(r.run_date)) for r in store.read("job_runs").collect())


def test_upsert_copy_leaves_the_old_table(spark, store):
    store.write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "t1")
    fresh = spark.createDataFrame([("b", 9)], "k string, v int")
    assert upsert_copy(store, "t1", fresh, ["k"], "t2") == 2
    assert sorted(map(tuple, store.read("t2").collect())) == [("a", 1), ("b", 9)]
    assert store.read("t1").where("v = 2").count() == 1


def files_of(store, run_id):
    stored = store.read("job_runs").where(F.col("run_id") == run_id)
    return {r[0] for r in stored.select("_metadata.file_path").collect()}


def test_partition_upsert_is_idempotent_and_touches_only_its_dates(store, slices):
    first = job_runs(slices(("j1", "a", 3, 1, "SUCCESS"), ("j1", "b", 2, 1, None)), AS_OF)
    store.write(first.withColumn("run_date", F.to_date("period_start_time")), "job_runs",
                partition_by=["run_date"])
    before = files_of(store, "a")
    fresh = job_runs(slices(("j1", "b", 2, 1, "FAILED"), ("j1", "c", 1, 1, "SUCCESS")), AS_OF)
    for _ in range(2):
        upsert_runs(store, fresh)
        assert table_rows(store) == [("a", "SUCCESS", "2024-01-28"), ("b", "FAILED", "2024-01-29"),
                                     ("c", "SUCCESS", "2024-01-30")]
    assert files_of(store, "a") == before
    assert upsert_runs(store, fresh.where("false")) == 0


def test_high_water_mark_and_newer(slices):
    df = slices(("j1", "a", 3, 1, "SUCCESS"), ("j1", "b", 2, 1, "SUCCESS"), ("j1", "c", 1, 1, "SUCCESS"))
    mark = high_water_mark(df.where("run_id != 'c'"))
    assert mark == "2024-01-29 00:00:00"
    assert {r.run_id for r in newer_slices(df, mark).collect()} == {"b", "c"}
    assert newer_slices(df, mark, overlap_days=1).count() == 3
    assert high_water_mark(df.where("false")) is None and newer_slices(df, None).count() == 3


def test_incremental_collection_equals_full(spark, store):
    slices = td.run_slices(spark, SF)
    early = slices.where("period_start_time < '2024-01-15'")
    collect_incremental(store, early, "2024-01-15 00:00:00")
    collect_incremental(store, slices, AS_OF)
    stored = store.read("job_runs")
    assert stored.count() == stored.select(*SLICE_KEYS).distinct().count() == slices.count()


def loaders(spark):
    return {
        "job_changes": lambda: td.job_changes(spark, SF),
        "run_slices": lambda: td.run_slices(spark, SF),
        "node_samples": lambda: td.node_samples(spark, SF),
        "usage": lambda: td.usage(spark, SF),
    }


def test_probe_and_gate(spark):
    broken = {**loaders(spark), "gone": lambda: spark.table("no.such")}
    got = {r["source"]: r.accessible for r in probe_sources(spark, broken).collect()}
    assert got == {**{k: True for k in loaders(spark)}, "gone": False}
    require_sources(spark, loaders(spark))
    with pytest.raises(PermissionError, match="gone"):
        require_sources(spark, broken)


def test_counts_and_reading_by_path(spark):
    sources = read_sources(spark, {"orders": f"{SF}/orders.parquet", "events": f"{SF}/events.parquet"})
    got = {r["source"]: r.row_count for r in count_sources(sources).collect()}
    assert got == {k: df.count() for k, df in sources.items()}


def test_pipeline_writes_all_tables(spark, store):
    settings = Settings(tie_break=["change_id"], channels=["slack"], anomaly_alerts=True)
    record = run_collection(store, loaders(spark), AS_OF, settings)
    assert record["status"] == "completed" and record["tables_updated"] == 6
    counts = json.loads(record["records_processed"])
    for table in ("jobs_metadata", "job_runs", "job_metrics", "job_baselines", "job_health",
                  "job_anomalies"):
        stored = store.read(table)
        assert stored.count() == counts[table] > 0
        assert stored.schema == TABLES[table]
    assert counts["jobs_metadata"] == counts["job_health"]
    sent = json.loads(record["alerts_sent"])
    low = store.read("job_health").where("health_score < 50").count()
    failed = store.read("job_runs").where("result_state = 'FAILED'").count()
    assert sent["job_failure"] == failed and sent["health_score_low"] == low and sent["cost_spike"] == 0
    alerts = store.read("job_alerts")
    assert alerts.count() == alerts.select("id").distinct().count()
    assert store.read("job_alerts").count() == sum(sent.values())
    log = recent_pipeline_runs(store.read("pipeline_runs")).collect()
    assert [r.run_id for r in log] == [record["run_id"]]
    worst = unhealthiest_jobs(store.read("job_health"), 3).collect()
    assert len(worst) == 3 and all(r.requires_attention for r in worst)
    direct = job_baselines(td.run_slices(spark, SF), AS_OF)
    assert tidy(store.read("job_baselines")).exceptAll(tidy(direct)).count() == 0


def test_increments_keep_one_version_and_pass_a_bad_clock(spark, store, slices):
    seen = slices(("j1", "a", 3, 1, None), ("j1", "a", 3, 5, "FAILED"), ("j1", None, 3, 1, "SUCCESS"),
                  ("j1", "ahead", -400, 1, "SUCCESS"))
    for _ in range(3):
        collect_incremental(store, seen, AS_OF)
    more = seen.union(slices(("j1", "b", 1, 2, "SUCCESS")))
    collect_incremental(store, more, AS_OF, overlap_days=1)
    got = sorted((r.run_id or "", r.result_state, r.duration_ms) for r in store.read("job_runs").collect())
    assert got == [("", "SUCCESS", 60_000), ("a", "FAILED", 300_000), ("b", "SUCCESS", 120_000)]


def test_late_slices_are_counted(spark, store, slices):
    first = slices(("j1", "a", 9, 1, "SUCCESS"), ("j1", "b", 1, 1, "SUCCESS"))
    collect_incremental(store, first, AS_OF)
    late = first.union(slices(("j1", "late", 5, 1, "FAILED")))
    collect_incremental(store, late, AS_OF)
    assert late_slices(store, late, AS_OF) == 1


def test_late_changes_are_counted_and_repaired(spark, store, slices):
    """Of old slices: one new, one longer, one with its state at last, one unchanged, one in an older version."""
    first = slices(
        ("j1", "same", 9, 1, "SUCCESS"), ("j1", "longer", 8, 1, "FAILED"), ("j1", "open", 7, 2, None),
        ("j1", "old", 6, 9, "SUCCESS"), ("j1", "b", 1, 1, "SUCCESS"),
    )
    collect_incremental(store, first, AS_OF)
    source = first.where("run_id <> 'old'").union(slices(
        ("j1", "late", 5, 1, "FAILED"), ("j1", "longer", 8, 4, "SUCCESS"), ("j1", "open", 7, 2, "FAILED"),
        ("j1", "old", 6, 3, None), ("j1", "late", 5, 1, "FAILED"),
    ))
    collect_incremental(store, source, AS_OF)
    assert late_slices(store, source, AS_OF) == late_slices(store, source, AS_OF, days=30) == 3
    assert late_slices(store, source, AS_OF, days=6) == 1
    assert collect_late(store, source, AS_OF, days=30) == 3
    assert late_slices(store, source, AS_OF) == collect_late(store, source, AS_OF) == 0
    got = sorted((r.run_id, r.result_state, r.duration_ms // 60_000) for r in store.read("job_runs").collect())
    assert got == [
        ("b", "SUCCESS", 1), ("late", "FAILED", 1), ("longer", "SUCCESS", 4), ("old", "SUCCESS", 9),
        ("open", "FAILED", 2), ("same", "SUCCESS", 1),
    ]


def test_collection_logs_late_slices(spark, store):
    """Slices that only come after the first collection, earlier than its overlap; then the repair of them."""
    late = "CAST(period_start_time AS DATE) = '2024-01-10'"
    early = {**loaders(spark), "run_slices": lambda: td.run_slices(spark, SF).where(f"NOT {late}")}
    n = td.run_slices(spark, SF).where(late).count()
    found = []
    for sources, way in ((early, "count"), (loaders(spark), "count"), (loaders(spark), "repair")):
        settings = Settings(tie_break=["change_id"], incremental_runs=True, late_runs=way)
        record = run_collection(store, sources, AS_OF, settings)
        found.append(json.loads(record["records_processed"])["late_slices"])
    assert found == [0, n, n] and n > 0
    assert store.read("job_runs").where(late).count() == n
    with pytest.raises(ValueError, match="late_runs"):
        Settings(late_runs="all")


def test_a_backfill_sees_nothing_later(spark):
    runs = job_runs(td.run_slices(spark, SF), "2024-01-15 00:00:00")
    assert runs.agg(F.max("period_start_time")).first()[0] <= datetime(2024, 1, 15)


def test_stages_without_rows_overwrite(spark, store):
    run_collection(store, loaders(spark), AS_OF, Settings(tie_break=["change_id"], threshold=0.5))
    assert store.read("job_anomalies").count() > 0
    run_collection(store, loaders(spark), AS_OF, Settings(tie_break=["change_id"], threshold=1e9))
    assert store.read("job_anomalies").count() == 0


def test_rate_limits_mark_what_is_not_sent(spark, store):
    settings = Settings(tie_break=["change_id"], rate_limits=True, max_per_hour=7)
    sent = json.loads(run_collection(store, loaders(spark), AS_OF, settings)["alerts_sent"])
    alerts = store.read("job_alerts")
    assert sum(sent.values()) == 7 < alerts.count()


def test_other_time_zones_are_refused(spark, store):
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        with pytest.raises(ValueError, match="not UTC"):
            run_collection(store, loaders(spark), AS_OF)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_incremental_pipeline_equals_the_full_one(spark, store):
    full = Store(spark, folder=shared_folder(spark))
    run_collection(full, loaders(spark), AS_OF, Settings(tie_break=["change_id"]))
    settings = Settings(tie_break=["change_id"], incremental_runs=True)
    early = {**loaders(spark), "run_slices": lambda: td.run_slices(spark, SF).where(
        "period_start_time < '2024-01-20'")}
    run_collection(store, early, "2024-01-20 00:00:00", settings)
    run_collection(store, loaders(spark), AS_OF, settings)
    for table in ("job_health", "job_baselines", "job_anomalies"):
        left, right = tidy(store.read(table)), tidy(full.read(table))
        assert left.exceptAll(right).count() == right.exceptAll(left).count() == 0
    scan = stored_runs(store, AS_OF, 5)._jdf.queryExecution().executedPlan().toString()
    assert "run_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert store.read("pipeline_runs").count() == 2


def test_pipeline_with_costs(spark, store):
    as_of = td.usage(spark, SF).agg(F.max("usage_date").cast("string")).first()[0] + " 00:00:00"
    settings = Settings(tie_break=["change_id"], costs=True, cost_alert_days=60)
    record = run_collection(store, loaders(spark), as_of, settings)
    costs = store.read("job_costs")
    assert json.loads(record["records_processed"])["job_costs"] == costs.count() > 0
    late = costs.where(f"cost_ratio > 1.5 AND usage_date >= date_sub('{as_of[:10]}', 60)").count()
    assert json.loads(record["alerts_sent"])["cost_spike"] == late > 0


def test_pipeline_logs_a_failure_and_raises(spark, store):
    broken = {**loaders(spark), "usage": lambda: spark.table("no.such")}
    with pytest.raises(PermissionError):
        run_collection(store, broken, AS_OF)
    row = store.read("pipeline_runs").first()
    assert row.status == "failed" and "usage" in json.loads(row.errors)[0]


def test_pipeline_with_no_failures_and_alerting_off(spark, store):
    none = {**loaders(spark), "run_slices": lambda: td.run_slices(spark, SF).where("false")}
    record = run_collection(store, none, AS_OF, Settings(alerting_enabled=False))
    counts = json.loads(record["records_processed"])
    assert counts["job_runs"] == counts["job_baselines"] == counts["job_anomalies"] == 0
    assert counts["job_health"] == counts["jobs_metadata"] > 0
    assert set(json.loads(record["alerts_sent"]).values()) == {0}
    assert not store.exists("job_alerts")


def test_run_log_report_newest_ten(spark, store):
    from datetime import UTC, timedelta

    for i in range(12):
        start = NOW.replace(tzinfo=UTC) + timedelta(minutes=30 * i)
        append_run_log(store, run_record(run_id=f"r{i:02d}", status="completed", start_time=start,
                                         end_time=start + timedelta(seconds=61.9)))
    got = recent_pipeline_runs(store.read("pipeline_runs")).collect()
    assert [r.run_id for r in got] == [f"r{i:02d}" for i in range(11, 1, -1)]
    assert {r.duration_seconds for r in got} == {61}
    assert got[-1].start_time == NOW + timedelta(hours=1)
