"""Values and sums of a log at moments, and what builds on them, against plain loops."""

import random
from datetime import timedelta

import pytest
from conftest import AS_OF, NOW, SF, plan_text
from pyspark.sql import functions as F

from jobtide.operators.alerts import failure_alerts
from jobtide.operators.jobs import latest_jobs, with_metadata_at
from jobtide.operators.runs import job_runs
from jobtide.operators.temporal import sums_at, value_at
from jobtide.operators.utilisation import job_utilisation
from jobtide.sources import testdata as td

LOG = "workspace_id string, job_id string, change_time timestamp, change_id long, name string, v double"
POINT = "workspace_id string, job_id string, at timestamp, n long, name string, _cell string"


def rows_of(seed, n=400):
    rng = random.Random(seed)
    job = lambda: None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"j{rng.randrange(5)}"
    when = lambda: NOW + timedelta(minutes=rng.randrange(0, 6000, 10))
    log = [("w", job(), when(), k, f"name {k}" if rng.random() < 0.9 else None, float(rng.randrange(9))) for k in range(n)]
    points = [("w", job(), None if rng.random() < 0.05 else when(), k, "old", "x") for k in range(n)]
    return log, points


@pytest.mark.parametrize("cell", [60, 3600, 10**7])
def test_values_at_moments_match_a_loop(spark, cell):
    log, points = rows_of(cell)
    found = value_at(
        spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame([*log, ("w", "hot", None, 999, "never", 1.0)], LOG),
        ["workspace_id", "job_id"], "at", "change_time", ["name"], ["change_id"], cell,
    )
    assert sorted(found.columns) == sorted(c.split()[0] for c in POINT.split(", "))
    for r in found.collect():
        before = [c for c in log if c[1] == r.job_id and r.at is not None and c[2] <= r.at]
        assert r.name == (max(before, key=lambda c: (c[2], c[3]))[4] if before else None)
    assert sorted(r.n for r in found.collect()) == list(range(len(points)))


@pytest.mark.parametrize("cell", [600, 10**7])
def test_sums_at_moments_match_a_loop(spark, cell):
    log, points = rows_of(cell + 1)
    found = sums_at(
        spark.createDataFrame(points, POINT), spark.createDataFrame(log, LOG), ["workspace_id", "job_id"],
        "at", "change_time", {"total": F.col("v"), "number": F.lit(1)}, cell,
    )
    for r in found.collect():
        before = [c[5] for c in log if c[1] == r.job_id and r.at is not None and c[2] <= r.at]
        assert (r.total, r.number) == ((sum(before), len(before)) if before else (None, None))


def test_no_rows_on_either_side(spark):
    log, points = rows_of(1, 5)
    keys = ["workspace_id", "job_id"]
    none = value_at(spark.createDataFrame(points, POINT), spark.createDataFrame([], LOG), keys, "at", "change_time", ["name"])
    assert {r.name for r in none.collect()} == {None} and none.count() == 5
    assert value_at(spark.createDataFrame([], POINT), spark.createDataFrame(log, LOG), keys, "at", "change_time", ["name"]).count() == 0


def test_the_join_in_time_compares_no_ranges(spark):
    changes = td.job_changes(spark, SF)
    plan = plan_text(with_metadata_at(td.run_slices(spark, SF), changes, "period_start_time"))
    assert "Join" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_later_changes_are_neither_used_nor_read(spark):
    jobs = latest_jobs(td.job_changes(spark, SF), "1996-01-01 00:00:00", ["change_id"])
    assert jobs.agg(F.max("created_time")).first()[0].year < 1996 and jobs.count() > 0
    assert "LessThanOrEqual(o_orderdate,1996-01-01" in plan_text(jobs)
    assert latest_jobs(td.job_changes(spark, SF), "1980-01-01 00:00:00").count() == 0


def test_failures_carry_the_name_of_their_time(spark, slices, jobs):
    runs = job_runs(slices(("j1", "a", 9, 1, "FAILED"), ("j1", "b", 5, 1, "FAILED"), ("j1", "c", 1, 1, "FAILED"), ("j2", "d", 1, 1, "FAILED")), AS_OF)
    log = [("w", "j1", NOW - timedelta(days=d), 0, name, 0.0) for d, name in ((7, "old"), (5, "new"), (-3, "later"))]
    found = failure_alerts(runs, jobs("other"), AS_OF, changes=spark.createDataFrame(log, LOG))
    names = {r.id.split("_")[4]: r.job_name for r in found.collect()}
    assert names == {"a": "Job j1", "b": "new", "c": "new", "d": "Job j2"}


SAMPLE = "cluster_id string, start_time timestamp, cpu_user_percent double, cpu_system_percent double"


def test_utilisation_matches_a_loop(spark, slices):
    rng = random.Random(4)
    runs = [(f"j{rng.randrange(4)}", f"r{k}", rng.randrange(1, 4000) / 1000, rng.randrange(0, 300), "SUCCESS") for k in range(60)]
    samples = [(f"c{rng.randrange(3)}", NOW - timedelta(seconds=rng.randrange(0, 4 * 86_400)), rng.random() * 60, rng.random() * 30) for _ in range(900)]
    samples += [("c0", None, 1.0, 1.0), ("c0", NOW - timedelta(hours=30), None, 1.0)]
    clusters = [("w", "j0", "c0"), ("w", "j0", "c1"), ("w", "j0", "c1"), ("w", "j1", "c2"), ("w", "j2", "c0"), ("w", "j9", "c0")]
    found = job_utilisation(
        slices(*runs), spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(clusters, "workspace_id string, job_id string, cluster_id string"), 120,
    )
    got = {r.job_id: r for r in found.collect()}
    for job in ("j0", "j1", "j2"):
        covered = busy = 0.0
        for j, _, days, minutes, _ in runs:
            s = NOW - timedelta(days=days)
            for cluster, at, user, system in samples:
                if j != job or at is None or user is None or ("w", job, cluster) not in clusters:
                    continue
                shared = (min(s + timedelta(minutes=minutes), at + timedelta(seconds=120)) - max(s, at)).total_seconds()
                covered += max(0.0, shared)
                busy += max(0.0, shared) * (user + system)
        assert got[job].covered_seconds == pytest.approx(covered, abs=1e-6)
        assert got[job].busy_percent == pytest.approx(busy / covered) and got[job].score == pytest.approx(min(1, busy / covered / 60))
    assert set(got) == {"j0", "j1", "j2"}
    plan = plan_text(found)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_job_without_samples_has_no_score(spark, slices):
    clusters = spark.createDataFrame([("w", "j1", "c0")], "workspace_id string, job_id string, cluster_id string")
    found = job_utilisation(slices(("j1", "a", 1, 5, "SUCCESS")), spark.createDataFrame([], SAMPLE), clusters)
    assert [(r.covered_seconds, r.busy_percent, r.score) for r in found.collect()] == [(0.0, None, None)]
