from datetime import date, datetime, timedelta

import pytest
from conftest import AS_OF, NOW, SF, plan_text
from pyspark.sql import functions as F

from jobtide.operators.jobs import latest_jobs, sample_jobs
from jobtide.operators.metrics import daily_metrics, window_metrics
from jobtide.operators.runs import job_runs
from jobtide.schemas import SOURCES, TABLES, conform
from jobtide.sources import testdata as td

CHANGES = (
    "workspace_id string, job_id string, change_time timestamp_ntz, version int, name string,"
    " owned_by string, creator_email string, created_time timestamp_ntz,"
    " settings struct<tasks: array<string>, notebook_task: string,"
    " python_wheel_task: string, jar_task: string>"
)


def change(job, day, version, name, settings=(None, None, None, None), ws="w"):
    at = datetime(2024, 1, day)
    return (ws, job, at, version, name, "o", "c@x", at, settings)


def test_latest_change_wins_per_workspace_and_job(spark):
    df = spark.createDataFrame(
        [change("a", 1, 1, "old"), change("a", 2, 1, "new"), change("a", 3, 1, "other", ws="v")],
        CHANGES,
    )
    got = {(r.workspace_id, r.job_name) for r in latest_jobs(df, AS_OF).collect()}
    assert got == {("w", "new"), ("v", "other")}


def test_tie_break_decides_equal_change_times(spark):
    df = spark.createDataFrame(
        [change("a", 1, v, f"v{v}") for v in (2, 3, 1)], CHANGES
    )
    assert latest_jobs(df, AS_OF, ["version"]).first().job_name == "v3"


def test_one_row_per_key_with_a_hot_key(spark):
    rows = [change("hot", 1 + i % 28, i, f"n{i}") for i in range(300)]
    rows += [change(f"j{i}", 1, 1, "x") for i in range(30)]
    got = latest_jobs(spark.createDataFrame(rows, CHANGES).repartition(8), AS_OF, ["version"])
    assert got.count() == 31
    hot = max((r for r in rows if r[1] == "hot"), key=lambda r: (r[2], r[3]))
    assert got.where("job_id = 'hot'").first().job_name == hot[4]


@pytest.mark.parametrize(
    "settings, kind",
    [
        ((["t"], "nb", "w", "j"), "MULTI_TASK"),
        ((None, "nb", "w", "j"), "NOTEBOOK"),
        ((None, None, "w", "j"), "PYTHON_WHEEL"),
        ((None, None, None, "j"), "JAR"),
        ((None, None, None, None), "UNKNOWN"),
        (None, "UNKNOWN"),
    ],
)
def test_job_type_precedence(spark, settings, kind):
    df = spark.createDataFrame([change("a", 1, 1, "n", settings)], CHANGES)
    assert latest_jobs(df, AS_OF).first().job_type == kind


def test_latest_jobs_plan_cuts_before_the_shuffle(spark):
    plan = plan_text(latest_jobs(td.job_changes(spark, SF), AS_OF, ["change_id"]))
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_sample_is_first_by_key(spark):
    df = spark.createDataFrame([change(f"j{i}", 1, 1, f"n{i}") for i in range(9)], CHANGES)
    got = [r.job_id for r in sample_jobs(latest_jobs(df, AS_OF), 3).collect()]
    assert got == ["j0", "j1", "j2"]


def test_runs_keep_the_window_edge_and_measure_ms(slices):
    df = slices(("j1", "in", 30, 2, "SUCCESS"), ("j1", "out", 30.001, 2, "SUCCESS"))
    got = job_runs(df, AS_OF).collect()
    assert [(r.run_id, r.duration_ms) for r in got] == [("in", 120_000)]
    assert got[0].collected_at == NOW


def test_open_slice_has_no_duration(slices):
    df = slices(("j1", "r", 1, 2, None)).withColumn(
        "period_end_time", F.lit(None).cast("timestamp_ntz")
    )
    assert job_runs(df, AS_OF).first().duration_ms is None


def test_runs_sorted_on_request(slices):
    df = slices(*[("j1", f"r{d}", d, 1, "SUCCESS") for d in (3, 1, 2)])
    got = [r.run_id for r in job_runs(df, AS_OF, newest_first=True).collect()]
    assert got == ["r1", "r2", "r3"]


def test_runs_filter_reaches_the_scan(spark):
    plan = plan_text(job_runs(td.run_slices(spark, SF), AS_OF, days=7))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan
    assert "Exchange" not in plan


def test_runs_accept_zoned_timestamps(slices):
    df = slices(("j1", "r", 1, 5, "SUCCESS"))
    zoned = df.select(
        *[F.col(c).cast("timestamp") if c.startswith("period") else c for c in df.columns]
    )
    assert job_runs(zoned, AS_OF).first().duration_ms == 300_000


SAMPLES = (
    "cluster_id string, start_time timestamp_ntz, cpu_user_percent double,"
    " cpu_system_percent double, cpu_idle_percent double, mem_used_percent double,"
    " network_received_bytes double, network_sent_bytes double"
)


def test_daily_metrics(spark):
    rows = [
        ("c", NOW - timedelta(days=7), 10.0, 5.0, 85.0, 40.0, 100.0, 50.0),
        ("c", NOW - timedelta(days=7) + timedelta(hours=1), 20.0, 5.0, 75.0, 60.0, 300.0, 50.0),
        ("c", NOW - timedelta(days=7, seconds=1), 99.0, 0.0, 1.0, 1.0, 1.0, 1.0),
        ("d", NOW, 1.0, 1.0, 98.0, None, 0.0, 0.0),
    ]
    df = daily_metrics(spark.createDataFrame(rows, SAMPLES), "2024-01-31 18:30:00", sort=True)
    first, second = df.collect()
    assert (first.cluster_id, first.day) == ("c", date(2024, 1, 24))
    assert first.avg_cpu_usage_percent == 20.0 and first.avg_network_bytes == 250.0
    assert first.metric_points == 2
    assert second.avg_memory_usage_percent is None
    assert df.schema["day"].dataType.simpleString() == "date"


def test_window_metrics_boundaries(spark):
    rows = [
        ("c", NOW + timedelta(minutes=m), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for m in (0, 4.99, 5)
    ]
    got = window_metrics(spark.createDataFrame(rows, SAMPLES)).orderBy("window_start").collect()
    assert [(r.window_start.minute, r.metric_points) for r in got] == [(0, 2), (5, 1)]


def test_conform_casts_orders_and_reports_missing(spark):
    df = spark.sql("SELECT 'w' workspace_id, 7 job_id, DATE'2024-01-01' usage_date, 1 extra")
    with pytest.raises(ValueError, match="usage_quantity"):
        conform(df, SOURCES["usage"])
    got = conform(df, SOURCES["usage"], fill_missing=True)
    assert got.columns == SOURCES["usage"].names
    assert got.first().job_id == "7" and got.first().usage_quantity is None
    assert conform(df, SOURCES["usage"], fill_missing=True, keep_extra=True).columns[-1] == "extra"


@pytest.mark.parametrize(
    "table, columns",
    [("jobs_metadata", 8), ("job_runs", 15), ("job_metrics", 8), ("job_baselines", 13),
     ("job_health", 14), ("job_anomalies", 8), ("pipeline_runs", 11)],
)
def test_declared_tables(table, columns):
    assert len(TABLES[table]) == columns
