import random

import numpy as np
import pytest
from conftest import AS_OF, SF, plan_text
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobtide.operators.baselines import job_baselines, run_totals
from jobtide.operators.percentiles import grouped_percentiles, ranked_percentiles
from jobtide.sources import testdata as td

POINTS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def frame(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, v bigint")


def check(spark, groups):
    got = {r["k"]: r for r in ranked_percentiles(frame(spark, groups), ["k"], "v", POINTS).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in POINTS.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (k, name)


def test_ranked_percentiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(7)
    hot = [rng.randrange(0, 5_000_000) for _ in range(3000)]
    same = [42] * 500
    check(spark, {"hot": hot, "same": same, "one": [-5], "two": [-1_000_000, 3_000_000],
                  "wide": [2**40, 1, -(2**40), 7, 7, 7]})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from("abc"),
                       st.lists(st.integers(-200_000, 200_000), min_size=1, max_size=40),
                       min_size=1))
def test_ranked_percentiles_property(spark, groups):
    check(spark, groups)


def test_ranked_equals_builtin_and_skips_nulls(spark):
    df = frame(spark, {"a": [1, 2, None, 70_000, 140_000], "b": [5, 5, 9]})
    ranked = sorted(ranked_percentiles(df, ["k"], "v", POINTS).collect())
    assert ranked == sorted(grouped_percentiles(df, ["k"], "v", POINTS).collect())


def test_ranked_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2)], "k string, v bigint")
    got = {r["k"]: r["p50"] for r in ranked_percentiles(df, ["k"], "v", POINTS).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_run_totals_sum_slices_and_drop_other_states(slices):
    df = slices(
        ("j1", "r1", 2, 1, "SUCCESS"), ("j1", "r1", 1, 2, "SUCCESS"), ("j1", "r2", 1, 4, "FAILED"),
        ("j1", "r3", 1, 8, None), ("j1", "r4", 31, 16, "SUCCESS"), ("j1", "r5", 3, 32, "SUCCESS"),
    )
    got = {r.run_id: r.total_duration_ms for r in run_totals(df, AS_OF).collect()}
    assert got == {"r1": 180_000, "r5": 1_920_000}
    early = run_totals(df, AS_OF, exclude_recent_days=2)
    assert {r.run_id for r in early.collect()} == {"r5"}


@pytest.mark.parametrize("bounded", [False, True])
def test_baseline_statistics(slices, bounded):
    minutes = [1, 2, 3, 4, 10]
    df = slices(*[("j1", f"r{m}", 1, m, "SUCCESS") for m in minutes],
                *[("j2", f"r{m}", 1, m, "SUCCESS") for m in minutes[:4]])
    rows = job_baselines(df, AS_OF, bounded_groups=bounded).collect()
    assert [r.job_id for r in rows] == ["j1"]
    r, ms = rows[0], np.array(minutes) * 60_000
    sd = ms.std(ddof=1)
    assert r.total_runs == 5
    assert r.avg_duration_ms == pytest.approx(ms.mean())
    assert r.stddev_duration_ms == pytest.approx(sd)
    assert r.median_duration_ms == pytest.approx(np.quantile(ms, 0.5))
    assert r.p90_duration_ms == pytest.approx(np.quantile(ms, 0.9))
    assert (r.min_duration_ms, r.max_duration_ms) == (60_000, 600_000)
    assert r.upper_threshold_ms == pytest.approx(ms.mean() + 2 * sd)
    assert r.lower_threshold_ms == pytest.approx(ms.mean() - 2 * sd)
    assert r.lower_threshold_ms < 0
    assert r.coefficient_of_variation == pytest.approx(sd / ms.mean())


def test_zero_mean_and_single_run(slices):
    zero = job_baselines(slices(*[("j1", f"r{i}", 1, 0, "SUCCESS") for i in range(5)]), AS_OF)
    assert zero.first().coefficient_of_variation == 0.0
    single = job_baselines(slices(("j1", "r", 1, 3, "SUCCESS")), AS_OF, min_runs=1).first()
    assert single.stddev_duration_ms is None
    assert single.upper_threshold_ms == single.lower_threshold_ms == 180_000
    assert single.coefficient_of_variation == 0.0


def test_percentiles_can_be_left_out(slices):
    df = slices(*[("j1", f"r{i}", 1, i, "SUCCESS") for i in range(5)])
    lean = job_baselines(df, AS_OF, percentiles=False)
    assert "median_duration_ms" not in lean.columns and "p90_duration_ms" not in lean.columns
    assert lean.first().total_runs == 5


def test_baselines_scan_the_slices_once(spark):
    df = job_baselines(td.run_slices(spark, SF), AS_OF)
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final
