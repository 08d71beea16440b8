"""Mergeable baselines, shared usage and the incremental cost table."""

import random
from datetime import timedelta

import pytest
from conftest import AS_OF, NOW, SF, plan_text
from pyspark.sql import functions as F

from checks.queries import tidy
from jobtide.operators.baselines import job_baselines
from jobtide.operators.costs import costs_since, daily_costs
from jobtide.operators.runcosts import cost_efficiency, run_costs, run_days
from jobtide.operators.sketches import RANK_ERROR, duration_days, merged_baselines
from jobtide.plans.pipeline import collect_costs, collect_duration_days
from jobtide.sinks.store import Store, shared_folder
from jobtide.sources import testdata as td


@pytest.fixture
def store(spark):
    return Store(spark, folder=shared_folder(spark))


def test_merged_moments_equal_those_of_all_runs(spark):
    slices = td.run_slices(spark, SF)
    merged = merged_baselines(duration_days(slices), AS_OF)
    direct = job_baselines(slices, AS_OF)
    names = [c for c in direct.columns if c not in ("median_duration_ms", "p90_duration_ms")]
    assert tidy(merged).select(names).exceptAll(tidy(direct).select(names)).count() == 0 and merged.count() == direct.count()


def test_rank_error_of_merged_percentiles(spark):
    """A hot job of 60,000 runs over 30 days, its values rising by day, so that no day is like the whole."""
    runs = spark.range(60_000).selectExpr(
        "'w' workspace_id", "'hot' job_id", "cast(id as string) run_id", "'SUCCESS' result_state",
        "timestamp'2024-01-01' + make_dt_interval(cast(id % 30 as int)) period_start_time",
        "(id % 30) * 1000000 + pmod(xxhash64(id), 900000) ms",
    ).selectExpr("*", "period_start_time + make_dt_interval(0, 0, 0, ms / 1000) period_end_time")
    stored = duration_days(runs)
    assert stored.count() == 30
    r = merged_baselines(stored, AS_OF).first()
    values = sorted(x.ms for x in runs.select("ms").collect())
    for point, found in ((0.5, r.median_duration_ms), (0.9, r.p90_duration_ms)):
        below = sum(v <= found for v in values) / len(values)
        assert abs(below - point) <= RANK_ERROR
    assert r.total_runs == 60_000 and r.avg_duration_ms == pytest.approx(sum(values) / len(values))


def test_duration_days_are_brought_up_to_date(spark, store):
    slices = td.run_slices(spark, SF)
    for as_of in ("2024-01-12 09:00:00", "2024-01-12 09:00:00", "2024-01-25 00:00:00", AS_OF):
        collect_duration_days(store, slices, as_of)
    names = ["job_id", "run_date", "run_count", "min_ms", "max_ms"]
    want = duration_days(slices.where(f"period_start_time <= '{AS_OF}'")).select(names)
    assert sorted(store.read("job_duration_days").select(names).collect()) == sorted(want.collect())


def test_runs_over_midnight_stay_whole(spark, store, slices):
    seen = slices(("j1", "a", 2.01, 30, "SUCCESS"), ("j1", "a", 1.98, 60, "SUCCESS"), ("j1", "b", 1.5, 5, "SUCCESS"))
    collect_duration_days(store, seen, NOW - timedelta(days=1.9))
    collect_duration_days(store, seen, AS_OF)
    got = sorted((str(r.run_date), r.run_count, r.max_ms) for r in store.read("job_duration_days").collect())
    assert got == [("2024-01-28", 1, 5_400_000), ("2024-01-29", 1, 300_000)]


USAGE = "workspace_id string, job_id string, usage_date date, usage_quantity double"


def test_shares_add_up_to_the_usage_of_every_day(spark, slices):
    rng = random.Random(2)
    runs = [(f"j{rng.randrange(3)}", f"r{rng.randrange(90)}", rng.randrange(0, 5000) / 1000, rng.randrange(0, 2500), rng.choice(["SUCCESS", "FAILED", None])) for _ in range(200)]
    usage = [("w", f"j{j}", (NOW - timedelta(days=d)).date(), rng.random() * 10) for j in range(4) for d in range(-1, 7)] + [("w", None, NOW.date(), 2.0)]
    frame = slices(*runs)
    costs = run_costs(frame, spark.createDataFrame(usage, USAGE))
    rows = costs.collect()
    for w, j, d, quantity in usage:
        own = [r for r in rows if (r.job_id, r.usage_date) == (j, d)]
        assert sum(r.cost_units for r in own) == round(quantity * 1e6)
        total = sum(r.run_ms for r in own)
        for r in own:
            assert r.run_id is None if total == 0 else abs(r.cost_units - round(quantity * 1e6) * r.run_ms / total) <= 1
    spent = {}
    for job, run, days, minutes, _ in runs:
        s = NOW - timedelta(days=days)
        e = s + timedelta(minutes=minutes)
        day = s.date()
        while day <= e.date():
            midnight = NOW.replace(year=day.year, month=day.month, day=day.day)
            shared = (min(e, midnight + timedelta(days=1)) - max(s, midnight)).total_seconds()
            spent[job, run, day] = spent.get((job, run, day), 0) + max(0, shared)
            day += timedelta(days=1)
    got = {(r.job_id, r.run_id, r.usage_date): r.run_ms / 1000 for r in run_days(frame).collect()}
    assert {k: v for k, v in got.items() if v} == pytest.approx({k: v for k, v in spent.items() if v})
    for r in cost_efficiency(costs).collect():
        own = [x for x in rows if x.job_id == r.job_id and x.run_id is not None]
        assert r.score == pytest.approx(sum(x.cost_units for x in own if x.succeeded) / sum(x.cost_units for x in own))
    assert run_costs(frame.limit(0), spark.createDataFrame(usage, USAGE)).count() == len(usage)
    assert run_costs(frame, spark.createDataFrame([], USAGE)).count() == 0


def test_costs_by_increments_equal_costs_at_once(spark, store):
    usage = td.usage(spark, SF)
    for as_of in ("1990-01-01 00:00:00", "1996-03-01 00:00:00", "1996-03-01 00:00:00", "1998-07-15 12:00:00", "2001-08-02 00:00:00"):
        collect_costs(store, usage, as_of)
    stored = store.read("job_costs").drop("usage_month")
    want = daily_costs(usage)
    assert tidy(stored).exceptAll(tidy(want)).count() == 0 and stored.count() == want.count()


def test_an_increment_reads_new_usage_only(spark, store):
    usage = td.usage(spark, SF)
    collect_costs(store, usage, "1996-07-15 00:00:00")
    plan = plan_text(costs_since(usage, store.read("job_costs"), F.lit("1996-07-14").cast("date"), "1996-08-01 00:00:00"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "orders" in line)
    assert "o_orderdate" in scan.split("DataFilters")[1] and "o_custkey,o_orderdate,o_totalprice" in plan.replace(" ", "") or "ReadSchema: struct<o_custkey" in plan
    assert daily_costs(usage, as_of="1996-01-01 00:00:00").agg(F.max("usage_date")).first()[0].year <= 1996
