"""Limits and history across collections."""

import json
import random
from datetime import timedelta

import pytest
from conftest import AS_OF, NOW, SF, plan_text
from pyspark.sql import functions as F

from checks.queries import alerts_rate_limited
from jobtide.operators.limits import after_quiet_period, first_per_period, rate_limited
from jobtide.plans.pipeline import Settings, run_collection
from jobtide.sinks.alertlog import alert_identity, append_history, marked_alerts
from jobtide.sinks.store import Store, shared_folder
from jobtide.sources import testdata as td

CANDIDATE = "alert_type string, workspace_id string, job_id string, created_at timestamp, id string"


def candidates(spark, seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        job = None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"j{rng.randrange(20)}"
        rows.append(("job_failure", "w", job, NOW + timedelta(seconds=rng.randrange(0, 3 * 86_400, 60)), f"a{i:04d}"))
    return sorted(rows, key=lambda r: (r[3], r[4]))


def test_limits_in_parts_equal_limits_at_once(spark):
    """Candidates of each day held to the limits with what the days before sent."""
    rows = candidates(spark, 7)
    whole = spark.createDataFrame(rows, CANDIDATE)
    want = {r.id: r.suppressed_by for r in rate_limited(whole, 45, 3, 20, ["id"]).collect()}
    got, sent = {}, []
    cuts = [NOW + timedelta(hours=h) for h in (0, 5, 6, 30, 72)]
    for a, b in zip(cuts, cuts[1:]):
        part = spark.createDataFrame([r for r in rows if a <= r[3] < b], CANDIDATE)
        found = rate_limited(part, 45, 3, 20, ["id"], sent_before=spark.createDataFrame(sent, CANDIDATE)).collect()
        got |= {r.id: r.suppressed_by for r in found}
        sent += [tuple(r)[:5] for r in found if r.suppressed_by is None]
    assert got == want and {None, "cooldown", "hour", "day"} == set(want.values())


def test_candidates_from_before_the_last_sent_alert_are_held_back(spark):
    rows = [("t", "w", "j", NOW - timedelta(minutes=m), f"m{m}") for m in (90, 20, 0)]
    before = spark.createDataFrame([("t", "w", "j", NOW - timedelta(minutes=40), "sent"), ("t", "w", "k", NOW, "other")], CANDIDATE)
    found = after_quiet_period(spark.createDataFrame(rows, CANDIDATE), 30, ["id"], sent_before=before)
    assert {r.id: r.suppressed_by for r in found.collect()} == {"m90": "cooldown", "m20": "cooldown", "m0": None}


def test_marked_candidates_have_no_part_in_limits(spark):
    rows = [("t", "w", f"j{k}", NOW, f"a{k}", "known" if k < 3 else None) for k in range(5)]
    found = rate_limited(spark.createDataFrame(rows, CANDIDATE + ", suppressed_by string"), 30, 2, 9, ["id"])
    assert {r.id: r.suppressed_by for r in found.collect()} == {"a0": "known", "a1": "known", "a2": "known", "a3": None, "a4": None}


def test_caps_have_one_lineage(spark):
    frame = spark.createDataFrame(candidates(spark, 1, 20), CANDIDATE).withColumn("suppressed_by", F.lit(None).cast("string"))
    plan = plan_text(first_per_period(first_per_period(frame, "hour", 2, ["id"]), "day", 5, ["id"]))
    assert plan.count("Scan ") == 1 and "Union" not in plan
    assert plan_text(alerts_rate_limited(spark, SF)).count("FileScan") == 2


def loaders(spark):
    return {
        "job_changes": lambda: td.job_changes(spark, SF),
        "run_slices": lambda: td.run_slices(spark, SF),
        "node_samples": lambda: td.node_samples(spark, SF),
        "usage": lambda: td.usage(spark, SF),
        "job_clusters": lambda: td.job_clusters(spark, SF),
    }


@pytest.mark.parametrize("limits", [False, True])
def test_two_collections_send_each_alert_once(spark, limits):
    store = Store(spark, folder=shared_folder(spark))
    settings = Settings(tie_break=["change_id"], rate_limits=limits, max_per_hour=30)
    sent = []
    for as_of in ("2024-01-30 12:00:00", "2024-01-30 12:05:00", "2024-01-30 12:05:00"):
        sent.append(sum(json.loads(run_collection(store, loaders(spark), as_of, settings)["alerts_sent"]).values()))
    history = store.read("job_alerts")
    assert history.count() == history.select(alert_identity()).distinct().count()
    assert sum(sent) == history.where("suppressed_by is null").count() and sent[2] == 0
    assert sent[0] == 30 if limits else sent[0] > 100
    if limits:
        assert sent[1] == 0
    # States of a job are news again on the next day, events are not.
    run_collection(store, loaders(spark), "2024-01-31 12:05:00", settings)
    later = store.read("job_alerts").where("alert_date = '2024-01-31'")
    assert {r.alert_type for r in later.select("alert_type").distinct().collect()} >= {"health_score_low"}
    assert later.where("alert_type = 'job_failure'").count() < history.where("alert_type = 'job_failure'").count() / 2


def test_history_in_a_database_and_backfills(spark):
    store = Store(spark, database="jobtide_alerts")
    rows = [("w", "j", "t", "title", "m", "n")]
    for minute, want in ((10, None), (20, "known"), (0, None)):
        at = NOW + timedelta(minutes=minute)
        alert = spark.createDataFrame(rows, "workspace_id string, job_id string, severity string, title string, message string, job_name string")
        alert = alert.selectExpr("*", f"'job_failure_w_j_r_1_{int(at.timestamp())}' id", "'job_failure' alert_type", "map('a', 'b') metadata", f"timestamp'{at}' created_at")
        marked = marked_alerts(store, alert, str(at))
        # A backfill does not see what a later collection has sent.
        assert [r.suppressed_by for r in marked.collect()] == [want]
        append_history(store, marked, ["slack"])
    assert store.read("job_alerts").count() == 2
    spark.sql("DROP DATABASE jobtide_alerts CASCADE")


def test_components_of_the_health_score(spark):
    store = Store(spark, folder=shared_folder(spark))
    parts = ("trend_analysis", "resource_utilization", "cost_efficiency")
    settings = Settings(tie_break=["change_id"], components=parts, sample_seconds=600, sketch_baselines=True)
    usage = lambda: td.run_slices(spark, SF).selectExpr("workspace_id", "job_id", "to_date(period_start_time) usage_date", "1.5D usage_quantity")
    record = run_collection(store, {**loaders(spark), "usage": usage}, AS_OF, settings)
    counts = json.loads(record["records_processed"])
    assert {"job_utilisation", "run_costs", "job_duration_days"} <= set(counts)
    plain = Store(spark, folder=shared_folder(spark))
    run_collection(plain, loaders(spark), AS_OF, Settings(tie_break=["change_id"]))
    same = store.read("job_health").select("job_id", "health_score").exceptAll(plain.read("job_health").select("job_id", "health_score"))
    scored = store.read("job_utilisation").where("score is not null").count()
    assert 0 < scored <= same.count() <= store.read("job_baselines").count() + 1
    costs = store.read("run_costs").agg(F.sum("cost_units")).first()[0]
    assert costs == 1_500_000 * td.run_slices(spark, SF).where(f"period_start_time <= '{AS_OF}'").count()
