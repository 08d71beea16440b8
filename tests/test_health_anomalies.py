import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from jobtide.functions.scores import (
    HEALTH_WEIGHTS,
    check_weights,
    health_category,
    stability_score,
    success_rate_score,
)
from jobtide.operators.anomalies import anomalies, job_anomalies, recent_stats
from jobtide.operators.baselines import job_baselines
from jobtide.operators.health import duration_trend, job_health, success_rates
from jobtide.operators.runs import job_runs

BASE = (
    "workspace_id string, job_id string, avg_duration_ms double, stddev_duration_ms double,"
    " coefficient_of_variation double"
)


def scored(spark, function, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


def test_success_steps(spark):
    got = scored(spark, success_rate_score, [1, 0.95, 0.9499, 0.9, 0.8, 0.7, 0.6999, 0])
    assert got == [1.0, 1.0, 0.9, 0.9, 0.7, 0.5, 0.2, 0.2]


def test_stability_steps(spark):
    got = scored(spark, stability_score, [0, 0.1, 0.1001, 0.2, 0.3, 0.5, 0.5001])
    assert got == [1.0, 1.0, 0.8, 0.8, 0.6, 0.4, 0.2]


def test_categories(spark):
    got = scored(spark, health_category, [85, 84.9, 70, 69.9, 50, 49.9])
    assert got == ["Excellent", "Good", "Good", "Fair", "Fair", "Poor"]


@pytest.mark.parametrize("delta, fine", [(0, True), (0.05, True), (-0.05, True),
                                         (0.06, False), (-0.06, False)])
def test_weight_sum(delta, fine):
    weights = {**HEALTH_WEIGHTS, "success_rate": HEALTH_WEIGHTS["success_rate"] + delta}
    if fine:
        check_weights(weights)
    else:
        with pytest.raises(ValueError):
            check_weights(weights)


def test_success_rates_count_null_state_as_not_successful(slices):
    runs = job_runs(slices(("j1", "a", 1, 1, "SUCCESS"), ("j1", "b", 1, 1, None),
                           ("j1", "c", 1, 1, "FAILED"), ("j1", "d", 1, 1, "SUCCESS")), AS_OF)
    r = success_rates(runs).first()
    assert (r.total_runs, r.successful_runs, r.success_rate) == (4, 2, 0.5)


def health_of(slices, jobs, rows, *names, **how):
    df = slices(*rows)
    runs = job_runs(df, AS_OF)
    health = job_health(jobs(*names), runs, job_baselines(df, AS_OF), AS_OF, **how)
    return {r.job_id: r for r in health.collect()}


def test_health_best_and_absent(slices, jobs):
    rows = [("j1", f"r{i}", 1, 10, "SUCCESS") for i in range(5)]
    rows += [("j9", "r", 1, 10, "SUCCESS")]
    got = health_of(slices, jobs, rows, "one", "two")
    assert set(got) == {"j1", "j2"}
    best, absent = got["j1"], got["j2"]
    assert best.health_score == pytest.approx(87.5) and best.health_category == "Excellent"
    assert best.requires_attention is False
    assert absent.health_score == pytest.approx(32.5) and absent.health_category == "Poor"
    assert absent.total_runs is None and absent.success_rate is None
    assert absent.requires_attention is True


def test_health_without_enough_runs_for_a_baseline(slices, jobs):
    got = health_of(slices, jobs, [("j1", f"r{i}", 1, 10, "SUCCESS") for i in range(4)], "one")
    assert got["j1"].stability_score is None
    assert got["j1"].health_score == pytest.approx(62.5)


def test_health_components_replace_placeholders(spark, slices, jobs):
    given = spark.createDataFrame([("w", "j1", 1.0)], "workspace_id string, job_id string, score double")
    rows = [("j1", f"r{i}", 1, 10, "SUCCESS") for i in range(5)]
    rows += [("j2", f"r{i}", 1, 10, "SUCCESS") for i in range(5)]
    got = health_of(slices, jobs, rows, "a", "b",
                    components={"cost_efficiency": given, "resource_utilization": given,
                                "trend_analysis": given})
    assert got["j1"].health_score == pytest.approx(100.0)
    assert got["j2"].health_score == pytest.approx(87.5)
    with pytest.raises(ValueError, match="unknown"):
        health_of(slices, jobs, rows, "a", components={"luck": given})


def test_duration_trend(slices):
    rows = [("up", f"r{d}", d, 30 - d, "SUCCESS") for d in range(1, 6)]
    rows += [("down", f"r{d}", d, d, "SUCCESS") for d in range(1, 6)]
    rows += [("flat", f"r{d}", d, 5, "SUCCESS") for d in range(1, 6)]
    rows += [("one", "r", 1, 5, "SUCCESS")]
    got = {r.job_id: (r.trend, r.score) for r in duration_trend(job_runs(slices(*rows), AS_OF)).collect()}
    assert got == {"up": (1, 0.2), "down": (-1, 1.0), "flat": (0, 0.6), "one": (0, 0.6)}


def detect(spark, recent, base, threshold=2.0):
    stats = spark.createDataFrame(
        [("w", j, v, 1) for j, v in recent],
        "workspace_id string, job_id string, recent_avg_duration double, recent_run_count bigint",
    )
    baselines = spark.createDataFrame([("w", j, a, s, 0.0) for j, a, s in base], BASE)
    return {r.job_id: r for r in anomalies(stats, baselines, AS_OF, threshold).collect()}


def test_anomaly_limits_are_strict(spark):
    base = [(j, 100.0, 10.0) for j in "abcde"]
    got = detect(spark, [("a", 120.0), ("b", 120.1), ("c", 80.0), ("d", 79.9), ("e", 100.0)], base)
    assert {j: r.anomaly_type for j, r in got.items()} == {"b": "SLOW", "d": "FAST"}
    assert got["d"].anomaly_score == pytest.approx(2.01) and got["d"].z_score == pytest.approx(-2.01)


def test_anomaly_deviation_floor_and_null(spark):
    got = detect(spark, [("a", 103.0), ("b", 103.0)], [("a", 100.0, 0.0), ("b", 100.0, None)])
    assert got["a"].z_score == got["b"].z_score == pytest.approx(3.0)


def test_anomaly_needs_a_baseline(spark):
    assert detect(spark, [("a", 1e9)], [("b", 1.0, 1.0)]) == {}


def test_recent_stats_grain_and_window(slices):
    runs = job_runs(slices(("j1", "r1", 1, 2, "SUCCESS"), ("j1", "r1", 2, 4, "SUCCESS"),
                           ("j1", "r2", 7, 6, "FAILED"), ("j1", "r3", 7.01, 100, "SUCCESS")), AS_OF)
    by_slice = recent_stats(runs, AS_OF).first()
    assert (by_slice.recent_avg_duration, by_slice.recent_run_count) == (240_000.0, 3)
    by_run = recent_stats(runs, AS_OF, grain="run").first()
    assert (by_run.recent_avg_duration, by_run.recent_run_count) == (360_000.0, 2)
    with pytest.raises(ValueError):
        recent_stats(runs, AS_OF, grain="job")


def test_excluding_the_recent_week_sharpens_the_baseline(slices):
    rows = [("j1", f"old{i}", 10 + i, 10 + i % 2, "SUCCESS") for i in range(10)]
    rows += [("j1", f"new{i}", 1 + i, 40, "SUCCESS") for i in range(5)]
    df = slices(*rows)
    runs = job_runs(df, AS_OF)
    shifted = job_anomalies(runs, job_baselines(df, AS_OF), AS_OF)
    sharp = job_anomalies(runs, job_baselines(df, AS_OF, exclude_recent_days=7), AS_OF)
    assert shifted.count() == 0
    assert sharp.first().anomaly_type == "SLOW"
