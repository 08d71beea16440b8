import json
import random
from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import AS_OF, NOW, SF, plan_text
from pyspark.sql import functions as F

from jobtide.functions.alert_text import metadata_text, severity_colour
from jobtide.operators.alerts import (
    RULES,
    AlertRule,
    alert_counts,
    anomaly_alerts,
    combine_alerts,
    cost_alerts,
    failed_runs,
    failure_alerts,
    health_alerts,
)
from jobtide.operators.costs import cost_spikes, daily_costs
from jobtide.operators.limits import after_quiet_period, first_per_period, rate_limited
from jobtide.operators.routing import alert_history, alert_payloads, route_alerts
from jobtide.operators.runs import job_runs
from jobtide.sources import testdata as td
from jobtide.operators.jobs import latest_jobs

EPOCH = 1706659200


def test_failure_alert_texts(slices, jobs):
    runs = job_runs(slices(("j1", "a", 1, 1, "FAILED", "disk full"), ("j1", "b", 2, 1, "FAILED", ""),
                           ("j7", "c", 3, 1, "FAILED"), ("j1", "d", 1, 1, "SUCCESS")), AS_OF)
    one, two, three = failure_alerts(runs, jobs("load"), AS_OF).orderBy("title", "message").collect()
    assert three.title == "Job Failure: load"
    assert three.message == "Job 'load' has failed with error: disk full"
    assert three.id.startswith("job_failure_w_j1_a_") and three.id.endswith(f"_{EPOCH}")
    assert three.severity == "high" and len({one.id, two.id, three.id}) == 3
    assert three.metadata == {"error_message": "disk full", "rule_threshold": "1"}
    assert three.created_at == NOW
    assert two.message.endswith("Unknown error")
    assert one.title == "Job Failure: Job j7" and one.job_name == "Job j7"


def test_failure_limit_takes_the_newest(slices, jobs):
    runs = job_runs(slices(*[("j1", f"r{d}", d, 1, "FAILED", f"e{d}") for d in range(1, 15)]), AS_OF)
    assert failure_alerts(runs, jobs("x"), AS_OF).count() == 14
    rule = replace(RULES["job_failure"], limit=10)
    got = {r.metadata["error_message"] for r in failure_alerts(runs, jobs("x"), AS_OF, rule).collect()}
    assert got == {f"e{d}" for d in range(1, 11)}


def test_unlimited_failures_keep_every_row_of_a_hot_job(slices, jobs):
    rows = [("j1", f"r{i}", i / 100, 1, "FAILED", f"e{i}") for i in range(400)]
    rows += [("j2", "x", 1, 1, "FAILED", "z"), ("j9", "y", 1, 1, "FAILED", "z")]
    got = failure_alerts(job_runs(slices(*rows), AS_OF), jobs("hot", "other"), at_event_time=True).collect()
    assert len(got) == len({r.id for r in got}) == 402
    assert {r.job_name for r in got} == {"hot", "other", "Job j9"}
    assert next(r for r in got if r.metadata["error_message"] == "e100").created_at == NOW - timedelta(days=1)


HEALTH = (
    "workspace_id string, job_id string, job_name string, owned_by string, health_score double"
)


def test_health_alerts_lowest_first(spark):
    rows = [("w", f"j{i}", f"n{i}" if i else None, "o", 50.0 - i) for i in range(8)]
    rule = replace(RULES["health_score_low"], limit=5)
    got = health_alerts(spark.createDataFrame(rows, HEALTH), AS_OF, rule).collect()
    assert {r.job_id for r in got} == {"j3", "j4", "j5", "j6", "j7"}
    low = next(r for r in got if r.job_id == "j7")
    assert low.message == "Job 'n7' has a health score of 43.0, below threshold of 50"
    assert low.title == "Low Health Score: n7" and low.id == f"health_low_w_j7_{EPOCH}"
    assert low.metadata == {"health_score": "43.0", "threshold": "50"}
    assert health_alerts(spark.createDataFrame(rows, HEALTH), AS_OF).count() == 7


def test_disabled_rules_and_alerting(spark, slices, jobs):
    runs = job_runs(slices(("j1", "a", 1, 1, "FAILED")), AS_OF)
    off = replace(RULES["job_failure"], enabled=False)
    assert failure_alerts(runs, jobs("x"), AS_OF, off).count() == 0
    on = failure_alerts(runs, jobs("x"), AS_OF)
    assert combine_alerts([on], enabled=False).count() == 0
    both = combine_alerts([on, failure_alerts(runs, jobs("x"), AS_OF, off)])
    assert [(r.alert_type, r.alert_count) for r in alert_counts(both).collect()] == [("job_failure", 1)]


def test_anomaly_alerts(spark, jobs):
    found = spark.createDataFrame(
        [("w", "j1", "SLOW", 3.25), ("w", "j2", "FAST", 2.0)],
        "workspace_id string, job_id string, anomaly_type string, anomaly_score double",
    )
    got = anomaly_alerts(found, jobs("a", "b"), AS_OF).collect()
    assert [r.job_id for r in got] == ["j1"]
    assert got[0].metadata == {"anomaly_type": "SLOW", "anomaly_score": "3.25", "threshold": "2.0"}


def routed(spark, slices, jobs):
    runs = job_runs(slices(("j1", "a", 1, 1, "FAILED", 'say "no"')), AS_OF)
    health = spark.createDataFrame([("w", "j2", "b", "o", 40.0)], HEALTH)
    return combine_alerts([failure_alerts(runs, jobs("a", "b"), AS_OF), health_alerts(health, AS_OF)])


def test_routing_marks_deliverable_channels(spark, slices, jobs):
    alerts = routed(spark, slices, jobs)
    got = {(r.alert_type, r.channel, r.deliverable) for r in route_alerts(alerts, ["slack"]).collect()}
    assert got == {("job_failure", "slack", True), ("job_failure", "email", False),
                   ("health_score_low", "slack", True)}
    rules = {**RULES, "health_score_low": replace(RULES["health_score_low"], channels=None)}
    got = {r.channel for r in route_alerts(alerts, ["email", "pager"], rules)
           .where("alert_type = 'health_score_low'").collect()}
    assert got == {"email", "pager"}
    nowhere = {k: replace(r, channels=()) for k, r in RULES.items()}
    for routed_ in (route_alerts(alerts, [], nowhere), route_alerts(alerts, ["slack"], {"other": RULES["cost_spike"]})):
        assert [(r.channel, r.deliverable) for r in routed_.collect()] == [(None, False)] * 2


def test_history_lists_channels(spark, slices, jobs):
    got = {r.alert_type: r.channels_sent
           for r in alert_history(routed(spark, slices, jobs), ["slack", "email"]).collect()}
    assert got == {"job_failure": ["email", "slack"], "health_score_low": ["slack"]}


def test_chat_payload_and_email(spark, slices, jobs):
    rows = {r.alert_type: r for r in alert_payloads(
        routed(spark, slices, jobs), channel="#ops", username="bot", icon_emoji=":x:").collect()}
    failure = rows["job_failure"]
    chat = json.loads(failure.chat_payload)
    assert chat["text"] == "Job Failure: a" and chat["channel"] == "#ops"
    assert chat["attachments"] == [{"color": "#ff0000", "fields": []}]
    header, section, fields = chat["blocks"]
    assert header == {"type": "header",
                      "text": {"type": "plain_text", "text": "\U0001f6a8 Job Failure: a"}}
    assert section["text"]["text"] == "Job 'a' has failed with error: say \"no\""
    assert [f["text"] for f in fields["fields"]] == [
        "*Job:* a", "*Severity:* HIGH", "*Time:* 2024-01-31 00:00:00 UTC"]
    assert failure.email_subject == "[Job alert] Job Failure: a"
    tail = failure.email_body.split("Additional Details:\n")[1]
    assert json.loads(tail) == {"error_message": 'say "no"', "rule_threshold": 1}
    assert tail == json.dumps({"error_message": 'say "no"', "rule_threshold": 1}, indent=2)
    assert "Severity: MEDIUM" in rows["health_score_low"].email_body


def test_payload_without_a_job(spark):
    row = spark.sql(
        "SELECT 'i' id, 'custom' alert_type, 'odd' severity, 't' title, 'm' message,"
        " cast(null as string) job_name, cast(map() as map<string,string>) metadata,"
        " timestamp'2024-01-31' created_at")
    got = alert_payloads(row).first()
    assert len(json.loads(got.chat_payload)["blocks"]) == 2
    assert got.colour == "#ff9500"
    assert "Job: N/A" in got.email_body and got.email_body.endswith("Additional Details:\nNone")


@pytest.mark.parametrize("severity, colour", [("low", "#36a64f"), ("medium", "#ff9500"),
                                              ("high", "#ff0000"), ("critical", "#8b0000"),
                                              ("?", "#ff9500")])
def test_colours(spark, severity, colour):
    assert spark.range(1).select(severity_colour(F.lit(severity))).first()[0] == colour


def test_metadata_null_value(spark):
    df = spark.sql("SELECT map('threshold', '2', 'error_message', cast(null as string)) m")
    got = df.select(metadata_text(F.col("m"))).first()[0]
    assert json.loads(got) == {"threshold": 2, "error_message": None}


# Rate limits against plain loops.

CANDIDATE = "alert_type string, workspace_id string, job_id string, created_at timestamp, id string, message string"


def candidates(spark, seed, n=600, hot=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        job = "hot" if rng.random() < hot else f"j{rng.randrange(20)}"
        at = NOW + timedelta(seconds=rng.randrange(0, 4 * 86_400, 60))
        rows.append(("job_failure", "w", job, at, f"a{i:04d}", "m"))
    return rows, spark.createDataFrame(rows, CANDIDATE).repartition(4)


def quiet_loop(rows, minutes):
    kept, last = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        at = r[3].replace(microsecond=0)
        if r[2] not in last or at - last[r[2]] >= timedelta(minutes=minutes):
            kept.append(r)
            last[r[2]] = at
    return kept


def cap_loop(rows, fmt, most):
    kept, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[0], r[1], r[2], r[4])):
        period = r[3].strftime(fmt)
        seen[period] = seen.get(period, 0) + 1
        if seen[period] <= most:
            kept.append(r)
    return kept


@pytest.mark.parametrize("minutes", [0, 1, 30, 45, 720])
def test_quiet_period_matches_a_loop(spark, minutes):
    rows, df = candidates(spark, minutes)
    marked = after_quiet_period(df, minutes, ["id"])
    assert marked.count() == len(rows)
    got = sorted(r.id for r in marked.where("suppressed_by is null").collect())
    assert minutes == 0 or got == sorted(r[4] for r in quiet_loop(rows, minutes))


def test_rate_limits_match_a_loop(spark):
    rows, df = candidates(spark, 3)
    want = cap_loop(cap_loop(quiet_loop(rows, 30), "%Y%m%d%H", 2), "%Y%m%d", 15)
    got = rate_limited(df, 30, 2, 15, tie_break=["id"])
    assert got.columns == [*df.columns, "suppressed_by"] and got.count() == len(rows)
    assert {r.suppressed_by for r in got.collect()} == {None, "cooldown", "hour", "day"}
    assert sorted(r.id for r in got.where("suppressed_by is null").collect()) == sorted(r[4] for r in want)


def test_caps_per_scope(spark):
    _, df = candidates(spark, 5)
    open_ = df.withColumn("suppressed_by", F.lit(None).cast("string"))
    got = first_per_period(open_, "day", 1, ["id"], scope=["job_id"]).where("suppressed_by is null")
    per = {(r.job_id, r.created_at.date()) for r in got.collect()}
    assert len(per) == got.count() == df.selectExpr("job_id", "date(created_at)").distinct().count()


def test_steady_failures_alert_again(spark):
    rows = [("job_failure", "w", "j", NOW + timedelta(minutes=20 * k), f"r{k}") for k in range(72)]
    df = spark.createDataFrame(rows, "alert_type string, workspace_id string, job_id string, created_at timestamp, id string")
    sent = after_quiet_period(df, 30, ["id"]).where("suppressed_by is null")
    assert sorted(r.id for r in sent.collect()) == sorted(f"r{k}" for k in range(0, 72, 2))


# Costs.

USAGE = "workspace_id string, job_id string, usage_date date, usage_quantity double"


def test_costs_and_spikes_match_a_loop(spark, jobs):
    rng = random.Random(1)
    rows = [("w", f"j{rng.randrange(1, 3)}", (NOW - timedelta(days=rng.randrange(25))).date(),
             float(rng.randrange(1, 100))) for _ in range(200)]
    daily = {}
    for _, job, day, amount in rows:
        daily[job, day] = daily.get((job, day), 0) + amount
    costs = daily_costs(spark.createDataFrame(rows, USAGE))
    got = {(r.job_id, r.usage_date): r for r in costs.collect()}
    assert set(got) == set(daily)
    spikes = set()
    for (job, day), total in daily.items():
        before = [daily[k] for k in sorted(daily) if k[0] == job and k[1] < day][-7:]
        r = got[job, day]
        assert r.usage == total
        if not before:
            assert r.trailing_avg is None and r.cost_ratio is None
            continue
        assert r.cost_ratio == pytest.approx(total / (sum(before) / len(before)))
        if r.cost_ratio > 1.5:
            spikes.add((job, day))
    found = cost_spikes(costs)
    assert {(r.job_id, r.usage_date) for r in found.collect()} == spikes
    alerts = cost_alerts(found, jobs("a", "b"), AS_OF)
    assert alerts.count() == len(spikes)
    assert alerts.first().title in ("Cost Spike: a", "Cost Spike: b")


def test_zero_average_is_no_spike(spark):
    rows = [("w", "j", NOW.date() - timedelta(days=1), 0.0), ("w", "j", NOW.date(), 5.0)]
    assert cost_spikes(daily_costs(spark.createDataFrame(rows, USAGE))).count() == 0


def test_name_join_does_not_scan_jobs_twice(spark):
    rule = replace(RULES["job_failure"], limit=10)
    df = failure_alerts(job_runs(td.run_slices(spark, SF), AS_OF),
                        latest_jobs(td.job_changes(spark, SF), AS_OF), AS_OF, rule)
    plan = plan_text(df)
    assert plan.count("FileScan") == 2 and "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
