"""Every operator as a query over the test tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

from jobtide.functions.clock import elapsed_ms, within_days
from jobtide.operators import alerts as al
from jobtide.operators.anomalies import job_anomalies, recent_stats
from jobtide.operators.baselines import job_baselines, run_totals
from jobtide.operators.costs import cost_spikes, daily_costs
from jobtide.operators.health import duration_trend, job_health, stability, success_rates
from jobtide.operators.jobs import latest_jobs, sample_jobs
from jobtide.operators.limits import rate_limited
from jobtide.operators.metrics import daily_metrics, window_metrics
from jobtide.operators.routing import alert_history, alert_payloads, route_alerts
from jobtide.operators.runcosts import cost_efficiency, run_costs
from jobtide.operators.runs import job_runs
from jobtide.operators.sketches import merged_baselines
from jobtide.operators.utilisation import job_utilisation
from jobtide.plans.pipeline import (
    Settings,
    collect_costs,
    collect_duration_days,
    collect_incremental,
    collect_late,
    run_collection,
)
from jobtide.plans.reports import recent_pipeline_runs, unhealthiest_jobs
from jobtide.sinks.alertlog import append_history, marked_alerts
from jobtide.sinks.store import Store, shared_folder
from jobtide.sources import testdata as td
from jobtide.sources.probe import count_sources, probe_sources
from jobtide.streaming.alerts import start_failure_alerts
from jobtide.streaming.cooldown import start_cooldown
from jobtide.streaming.counts import batch_counts, batch_log
from jobtide.streaming.metrics import start_metrics
from jobtide.streaming.runs import start_runs

AS_OF = td.EVENTS_AS_OF
SNAPSHOT = "2024-01-20 00:00:00"
CONFIGURED = ("slack", "webhook")
LIMITS = {"cooldown_minutes": 720, "max_per_hour": 2, "max_per_day": 20}
COOLDOWN_MINUTES = 720
#: Moments of collections that follow each other, the second before anything can be sent again.
COLLECTIONS = ("2024-01-20 00:00:00", "2024-01-20 00:05:00", "2024-01-20 11:00:00", "2024-01-20 12:30:00")
LIMITS_ACROSS = {"cooldown_minutes": 720, "max_per_hour": 25, "max_per_day": 40}
#: A moment inside of the orders' change log, and how late changes are known there.
MIDWAY = "1998-06-17 00:00:00"
CHANGE_DELAY_DAYS = 45
SAMPLE_SECONDS = 600
LATENESS = "10 days"


def places(column: str) -> int:
    """Digits kept: fewer for large milliseconds and bytes, more for averaged percents."""
    if any(part in column for part in ("_ms", "duration", "bytes")):
        return 3
    return 8 if column.endswith("_percent") else 6


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded, timestamps without time zone."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, places(f.name))
        elif isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def _jobs(spark, sf):
    return latest_jobs(td.job_changes(spark, sf), AS_OF, ["change_id"])


def _runs(spark, sf):
    return job_runs(td.run_slices(spark, sf), AS_OF)


def _baselines(spark, sf):
    return job_baselines(td.run_slices(spark, sf), AS_OF, percentiles=False)


def _health(spark, sf):
    return job_health(_jobs(spark, sf), _runs(spark, sf), _baselines(spark, sf), AS_OF)


def _anomalies(spark, sf, threshold):
    return job_anomalies(_runs(spark, sf), _baselines(spark, sf), AS_OF, threshold)


def _alerts(spark, sf):
    return al.combine_alerts(
        [
            al.failure_alerts(_runs(spark, sf), _jobs(spark, sf), AS_OF),
            al.health_alerts(_health(spark, sf), AS_OF),
        ]
    )


def _flat(alerts: DataFrame, *keys: str) -> DataFrame:
    """Alert rows with metadata entries as columns in place of the map."""
    entries = [F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys]
    return alerts.select(*[c for c in alerts.columns if c != "metadata"], *entries)


def jobs_latest(spark, sf):
    return tidy(_jobs(spark, sf).drop("job_type"))


def jobs_latest_midway(spark, sf):
    """Metadata as of a moment that many changes are later than."""
    return tidy(latest_jobs(td.job_changes(spark, sf), MIDWAY, ["change_id"]))


def job_type(spark, sf):
    jobs = _jobs(spark, sf)
    return jobs.select("workspace_id", "job_id", "job_type")


def jobs_sample(spark, sf):
    return tidy(sample_jobs(_jobs(spark, sf)))


def job_runs_window(spark, sf):
    return tidy(job_runs(td.run_slices(spark, sf), AS_OF, days=14))


def cluster_daily_metrics(spark, sf):
    return tidy(daily_metrics(td.node_samples(spark, sf), AS_OF))


def run_totals_query(spark, sf):
    return run_totals(td.multi_slices(spark, sf), td.ORDERS_AS_OF, td.ORDERS_DAYS)


def job_baselines_query(spark, sf):
    return tidy(job_baselines(td.multi_slices(spark, sf), td.ORDERS_AS_OF, td.ORDERS_DAYS))


def job_baselines_bounded(spark, sf):
    return tidy(
        job_baselines(
            td.multi_slices(spark, sf), td.ORDERS_AS_OF, td.ORDERS_DAYS, bounded_groups=True
        )
    )


def baselines_exclude_recent(spark, sf):
    return tidy(job_baselines(td.run_slices(spark, sf), AS_OF, exclude_recent_days=7))


def baselines_20_days(spark, sf):
    """A window that leaves out a third of the runs."""
    return tidy(job_baselines(td.run_slices(spark, sf), AS_OF, days=20))


def job_baselines_merged(spark, sf):
    """Daily statistics stored by one collection and brought up to date by the next, then merged."""
    store = Store(spark, folder=shared_folder(spark))
    for as_of in (SNAPSHOT, AS_OF):
        collect_duration_days(store, td.run_slices(spark, sf), as_of)
    return tidy(merged_baselines(store.read("job_duration_days"), AS_OF))


def success_rate(spark, sf):
    return tidy(success_rates(_runs(spark, sf)))


def stability_query(spark, sf):
    return tidy(stability(_baselines(spark, sf)))


def job_health_query(spark, sf):
    return tidy(_health(spark, sf))


def job_health_trend(spark, sf):
    runs = _runs(spark, sf)
    health = job_health(
        _jobs(spark, sf),
        runs,
        _baselines(spark, sf),
        AS_OF,
        components={"trend_analysis": duration_trend(runs)},
    )
    return tidy(health.select("workspace_id", "job_id", "health_score", "health_category"))


def _utilisation(spark, sf):
    return job_utilisation(
        _runs(spark, sf), td.node_samples(spark, sf), td.job_clusters(spark, sf), SAMPLE_SECONDS
    )


def job_utilisation_query(spark, sf):
    # Integrals over long times leave about ten digits.
    return tidy(_utilisation(spark, sf).withColumn("busy_percent", F.round("busy_percent", 4)))


def job_health_components(spark, sf):
    """Health with utilisation and trend in place of their fixed parts."""
    runs = _runs(spark, sf)
    parts = {"resource_utilization": _utilisation(spark, sf), "trend_analysis": duration_trend(runs)}
    health = job_health(_jobs(spark, sf), runs, _baselines(spark, sf), AS_OF, components=parts)
    return tidy(health.select("workspace_id", "job_id", "health_score", "health_category"))


def recent_stats_query(spark, sf):
    return tidy(recent_stats(_runs(spark, sf), AS_OF))


def anomalies_t2(spark, sf):
    return tidy(_anomalies(spark, sf, 2.0))


def anomalies_t1(spark, sf):
    return tidy(_anomalies(spark, sf, 1.0))


def anomalies_run_grain(spark, sf):
    slices = td.multi_slices(spark, sf)
    runs = slices.withColumn("duration_ms", elapsed_ms("period_start_time", "period_end_time"))
    baselines = job_baselines(slices, td.ORDERS_AS_OF, td.ORDERS_DAYS, percentiles=False)
    return tidy(
        job_anomalies(runs, baselines, td.ORDERS_AS_OF, threshold=1.0, days=365, grain="run")
    )


def failure_alerts(spark, sf):
    rule = replace(al.RULES["job_failure"], limit=10)
    found = al.failure_alerts(_runs(spark, sf), _jobs(spark, sf), AS_OF, rule)
    return tidy(_flat(found, "error_message", "rule_threshold"))


def failure_alerts_all(spark, sf):
    found = al.failure_alerts(
        _runs(spark, sf), _jobs(spark, sf), at_event_time=True
    )
    return tidy(_flat(found, "error_message", "rule_threshold"))


def failures_named_at_start(spark, sf):
    """Failed runs up to a moment inside of the change log, with the names their jobs had at the start."""
    slices = td.multi_slices(spark, sf)
    delay = F.make_dt_interval(days=F.lit(CHANGE_DELAY_DAYS))
    changes = td.job_changes(spark, sf).withColumn("change_time", F.col("change_time") + delay)
    runs = (
        slices.where(within_days(slices, "period_start_time", MIDWAY, 365))
        .select("workspace_id", "job_id", "run_id", "period_start_time", "result_state")
        .distinct()
        .withColumn("state_message", F.lit(None).cast("string"))
    )
    found = al.failure_alerts(
        runs, latest_jobs(changes, MIDWAY, ["change_id"]), at_event_time=True, changes=changes, tie_break=["change_id"]
    )
    return tidy(found.select("id", "workspace_id", "job_id", "job_name", "title", "created_at"))


def alerts_across_collections(spark, sf):
    """The history after four collections: what each sent, and which limit held the others back."""
    store = Store(spark, folder=shared_folder(spark))
    for as_of in COLLECTIONS:
        jobs = latest_jobs(td.job_changes(spark, sf), as_of, ["change_id"])
        found = al.failure_alerts(job_runs(td.run_slices(spark, sf), as_of), jobs, as_of)
        marked = marked_alerts(store, found, as_of, limits=LIMITS_ACROSS).persist()
        append_history(store, marked, CONFIGURED)
        marked.unpersist()
    return tidy(store.read("job_alerts").select("id", "workspace_id", "job_id", "created_at", "suppressed_by", "alert_date"))


def alert_colours(spark, sf):
    """All severities, and alerts that are about no job."""
    rules = {k: replace(al.RULES[k], severity=s) for k, s in (("job_failure", "critical"), ("health_score_low", "low"))}
    alerts = al.combine_alerts(
        [
            al.failure_alerts(_runs(spark, sf), _jobs(spark, sf), AS_OF, rules["job_failure"]),
            al.health_alerts(_health(spark, sf), AS_OF, rules["health_score_low"]),
            al.anomaly_alerts(_anomalies(spark, sf, 1.0), _jobs(spark, sf), AS_OF),
        ]
    )
    count = F.count(F.lit(1)).cast("string")
    digests = alerts.groupBy("alert_type").agg(
        F.concat(F.lit("digest_"), F.first("alert_type")).alias("id"),
        F.lit("high").alias("severity"),
        F.concat(count, F.lit(" alerts")).alias("title"),
        F.concat(F.lit("Jobs: "), F.count_distinct("workspace_id", "job_id").cast("string")).alias("message"),
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("job_name"),
        F.lit(None).cast("string").alias("workspace_id"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"),
    )
    found = alert_payloads(alerts.unionByName(digests))
    chat = F.when(F.col("id").startswith("digest_"), F.col("chat_payload")).alias("chat_payload")
    return found.select("id", "colour", chat, "email_subject")


def health_alerts(spark, sf):
    rule = replace(al.RULES["health_score_low"], limit=5)
    found = al.health_alerts(_health(spark, sf), AS_OF, rule)
    return tidy(_flat(found, "health_score", "threshold"))


def health_alerts_all(spark, sf):
    return tidy(_flat(al.health_alerts(_health(spark, sf), AS_OF), "health_score", "threshold"))


def anomaly_alerts(spark, sf):
    rule = replace(al.RULES["performance_anomaly"], threshold=1.0)
    found = al.anomaly_alerts(_anomalies(spark, sf, 1.0), _jobs(spark, sf), AS_OF, rule)
    return tidy(_flat(found, "anomaly_type", "threshold"))


def alerts_routed(spark, sf):
    routed = route_alerts(_alerts(spark, sf), CONFIGURED)
    return routed.select("id", "alert_type", "severity", "title", "channel", "deliverable")


def alert_payloads_query(spark, sf):
    return alert_payloads(_alerts(spark, sf))


def alert_history_query(spark, sf):
    history = alert_history(_alerts(spark, sf), CONFIGURED)
    return tidy(
        history.withColumn("channels_sent", F.array_join("channels_sent", ",")).drop("metadata")
    )


def alert_counts(spark, sf):
    return al.alert_counts(_alerts(spark, sf))


def alerts_rate_limited(spark, sf):
    candidates = al.failed_runs(_runs(spark, sf))
    marked = rate_limited(candidates, tie_break=["run_id"], **LIMITS)
    return tidy(marked.select("workspace_id", "job_id", "run_id", "created_at", "suppressed_by"))


def source_counts(spark, sf):
    return count_sources(
        {
            "job_changes": td.job_changes(spark, sf),
            "run_slices": td.run_slices(spark, sf),
            "node_samples": td.node_samples(spark, sf),
            "usage": td.usage(spark, sf),
        }
    )


def source_probe(spark, sf):
    loaders = {
        "job_changes": lambda: td.job_changes(spark, sf),
        "run_slices": lambda: td.run_slices(spark, sf),
        "node_samples": lambda: td.node_samples(spark, sf),
        "usage": lambda: td.usage(spark, sf),
        "missing": lambda: td.table(spark, sf, "no_such_table"),
    }
    return probe_sources(spark, loaders)


def top_unhealthy(spark, sf):
    return tidy(unhealthiest_jobs(_health(spark, sf)))


def pipeline_log(runs: DataFrame) -> DataFrame:
    """A run log with one record per day of the run slices."""
    return (
        runs.groupBy(F.to_date("period_start_time").alias("_day"))
        .agg(
            F.min("period_start_time").alias("start_time"),
            F.max("period_end_time").alias("end_time"),
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("result_state") == "FAILED").alias("failed"),
        )
        .select(
            F.concat(F.lit("run-"), F.col("_day").cast("string")).alias("run_id"),
            F.when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"),
            "start_time",
            "end_time",
            F.floor(elapsed_ms("start_time", "end_time") / 1000).alias("duration_seconds"),
            F.to_json(F.struct("runs")).alias("records_processed"),
            F.lit(6).alias("tables_updated"),
            F.to_json(F.struct(F.col("failed").alias("job_failure"))).alias("alerts_sent"),
            F.lit("[]").alias("errors"),
            F.lit("development").alias("environment"),
            F.lit(30).alias("collection_window_days"),
        )
    )


def recent_pipeline_runs_query(spark, sf):
    store = Store(spark, folder=shared_folder(spark))
    store.write(pipeline_log(_runs(spark, sf)), "pipeline_runs", mode="append")
    return tidy(recent_pipeline_runs(store.read("pipeline_runs")))


def write_read_roundtrip(spark, sf):
    """Successful runs first, then the others with one more column, read as one table."""
    store = Store(spark, folder=shared_folder(spark))
    runs = _runs(spark, sf)
    good = F.coalesce(F.col("result_state") == "SUCCESS", F.lit(False))
    store.write(runs.where(good), "job_runs", mode="overwrite")
    others = runs.where(~good).withColumn("needs_review", F.lit(True))
    store.write(others, "job_runs", mode="append")
    return tidy(store.read("job_runs", merge_schema=True))


def metrics_5min(spark, sf):
    return tidy(window_metrics(td.node_samples(spark, sf)))


def cost_daily(spark, sf):
    return tidy(daily_costs(td.usage(spark, sf)))


def cost_spikes_query(spark, sf):
    return tidy(cost_spikes(daily_costs(td.usage(spark, sf))))


def cost_alerts(spark, sf):
    found = al.cost_alerts(cost_spikes(daily_costs(td.usage(spark, sf))), _jobs(spark, sf))
    return tidy(_flat(found, "usage_date", "threshold").drop("message"))


def costs_incremental(spark, sf):
    """The cost table after two collections, the second reading only newer usage."""
    store = Store(spark, folder=shared_folder(spark))
    for as_of in (MIDWAY, "1999-01-31 00:00:00"):
        collect_costs(store, td.usage(spark, sf), as_of)
    return tidy(store.read("job_costs"))


def _run_costs(spark, sf):
    """Usage of orders shared to their runs, which start half an hour before midnight."""
    late = F.make_dt_interval(mins=F.lit(1410))
    slices = td.multi_slices(spark, sf).withColumns(
        {c: F.col(c) + late for c in ("period_start_time", "period_end_time")}
    )
    return run_costs(slices, td.usage(spark, sf))


def run_costs_query(spark, sf):
    return tidy(_run_costs(spark, sf))


def cost_efficiency_query(spark, sf):
    return tidy(cost_efficiency(_run_costs(spark, sf)))


def _with_repeats(slices: DataFrame, open_since: str) -> DataFrame:
    """Every third slice twice, first without state and shorter; no states from a moment on."""
    version = F.explode(
        F.when(F.col("run_id").cast("long") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    )
    final = (F.col("_version") == 2) & (F.col("period_start_time") < F.lit(open_since).cast("timestamp_ntz"))
    second = F.make_dt_interval(secs=F.lit(1).cast("decimal(18,6)"))
    return (
        slices.withColumn("_version", version)
        .withColumns(
            {
                "result_state": F.when(final, F.col("result_state")),
                "period_end_time": F.when(F.col("_version") == 2, F.col("period_end_time")).otherwise(
                    F.col("period_end_time") - second
                ),
            }
        )
        .drop("_version")
    )


def runs_upsert(spark, sf):
    """A snapshot whose last two days still miss their states, then the newer slices, some in two versions."""
    store = Store(spark, folder=shared_folder(spark))
    slices = td.run_slices(spark, sf)
    collect_incremental(store, _with_repeats(slices, "2024-01-18 00:00:00"), SNAPSHOT, 30)
    collect_incremental(store, _with_repeats(slices, "2100-01-01 00:00:00"), AS_OF, overlap_days=2)
    return tidy(store.read("job_runs").drop("collected_at"))


def runs_late_repaired(spark, sf):
    """States of ten days that only come after the overlap has passed them, brought in as late slices."""
    store = Store(spark, folder=shared_folder(spark))
    slices = td.run_slices(spark, sf)
    collect_incremental(store, _with_repeats(slices, "2024-01-10 00:00:00"), SNAPSHOT, 30)
    whole = _with_repeats(slices, "2100-01-01 00:00:00")
    collect_incremental(store, whole, AS_OF, overlap_days=0)
    collect_late(store, whole, AS_OF, overlap_days=0, days=40)
    return tidy(store.read("job_runs").drop("collected_at"))


def _collection(spark, sf) -> Store:
    """A store with everything that one collection writes."""
    store = Store(spark, folder=shared_folder(spark))
    loaders = {
        "job_changes": lambda: td.job_changes(spark, sf),
        "run_slices": lambda: td.run_slices(spark, sf),
        "node_samples": lambda: td.node_samples(spark, sf),
        "usage": lambda: td.usage(spark, sf),
    }
    settings = Settings(channels=CONFIGURED, tie_break=["change_id"], costs=True, metrics_width="5 minutes")
    run_collection(store, loaders, AS_OF, settings)
    return store


def collection_counts(spark, sf):
    """Rows of every table that a collection writes, and its alerts by kind, read back."""
    store = _collection(spark, sf)
    tables = ["jobs_metadata", "job_runs", "job_metrics", "job_window_metrics", "job_baselines"]
    tables += ["job_health", "job_anomalies", "job_costs"]
    counts = [
        store.read(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("name"), "row_count")
        for t in tables
    ]
    alerts = al.alert_counts(store.read("job_alerts")).toDF("name", "row_count")
    return reduce(DataFrame.unionByName, [*counts, alerts])


def collection_run_log(spark, sf):
    """The record that a collection appends to its run log."""
    log = _collection(spark, sf).read("pipeline_runs")
    return log.select(
        "status", "environment", "collection_window_days", "records_processed", "alerts_sent", "errors"
    )


def _event_stream(spark, sf, place, quarters=range(4)):
    """The events, or some quarters of them, written quarter by quarter of their time, and read in micro-batches.

    A micro-batch has about as many files as a quarter: the batches grow with the table, not their number, as each has
    its state to commit and dates to rewrite. A quarter is shorter than the streams' lateness.
    """
    events = td.table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    for k in quarters:
        part = F.col("ts") >= F.lit(first + k * step).cast("timestamp_ntz")
        if k < 3:
            part &= F.col("ts") < F.lit(first + (k + 1) * step).cast("timestamp_ntz")
        events.where(part).write.mode("append").parquet(f"{place}/events")
    # Earlier quarters, if any, lie in the folder already.
    files = len(spark.read.schema(events.schema).parquet(f"{place}/events").inputFiles())
    of_quarter = max(1, -(-files // (max(quarters) + 1)))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", of_quarter).parquet(f"{place}/events")


def metrics_stream(spark, sf):
    place = shared_folder(spark)
    store = Store(spark, folder=place)
    samples = td.event_samples(_event_stream(spark, sf, place))
    start_metrics(samples, store, f"{place}/checkpoint", lateness=LATENESS).awaitTermination()
    return tidy(store.read("job_window_metrics").drop("day"))


def runs_stream_dedup(spark, sf):
    """Every third event is delivered twice; the table holds each slice once."""
    place = shared_folder(spark)
    store = Store(spark, folder=place)
    copies = F.expr("explode(CASE WHEN event_id % 3 = 0 THEN array(1, 2) ELSE array(1) END)")
    events = _event_stream(spark, sf, place).withColumn("_copy", copies).drop("_copy")
    slices = td.event_slices(events)
    start_runs(slices, store, f"{place}/checkpoint", as_of=AS_OF).awaitTermination()
    return tidy(store.read("job_runs"))


def failure_alerts_stream(spark, sf):
    """Failures and metadata changes as two streams: every failure with the name of its time."""
    place = shared_folder(spark)
    store = Store(spark, folder=place)
    events = _event_stream(spark, sf, place)
    start_failure_alerts(
        td.event_slices(events), td.event_changes(events), store, f"{place}/checkpoint", lateness=LATENESS, names_from="40 days"
    ).awaitTermination()
    alerts = store.read("failure_alerts").select("id", "workspace_id", "job_id", "job_name", "message", "created_at", "alert_date")
    return tidy(alerts)


def _failures(events):
    return (
        td.event_slices(events)
        .where("result_state = 'FAILED'")
        .select(
            F.lit("job_failure").alias("alert_type"),
            "workspace_id",
            "job_id",
            F.col("period_start_time").alias("created_at"),
        )
    )


def alert_cooldown_stream(spark, sf):
    place = shared_folder(spark)
    candidates = _failures(_event_stream(spark, sf, place))
    start_cooldown(
        candidates, f"{place}/out", f"{place}/checkpoint", COOLDOWN_MINUTES, LATENESS
    ).awaitTermination()
    return tidy(spark.read.parquet(f"{place}/out"))


def stream_batch_counts(spark, sf):
    """Alerts sent as the run log counts them by micro-batch, over a restart, beside the rows of the table."""
    place = shared_folder(spark)
    store = Store(spark, folder=place)
    with batch_log(store) as log:
        for quarters in (range(2), range(2, 4)):
            candidates = _failures(_event_stream(spark, sf, place, quarters))
            query = start_cooldown(
                candidates, f"{place}/out", f"{place}/checkpoint", COOLDOWN_MINUTES, LATENESS
            )
            query.awaitTermination()
            log.wait_for(query)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    logged = batch_counts(store.read("pipeline_runs")).select(
        F.col("table").alias("name"), F.col("row_count").alias("rows_logged"), zero.alias("rows_stored")
    )
    stored = spark.read.parquet(f"{place}/out").select(
        F.lit("alerts_sent").alias("name"), zero.alias("rows_logged"), one.alias("rows_stored")
    )
    sums = [F.sum(c).alias(c) for c in ("rows_logged", "rows_stored")]
    return logged.unionByName(stored).groupBy("name").agg(*sums)


QUERIES = {
    "jobs_latest": jobs_latest,
    "jobs_latest_midway": jobs_latest_midway,
    "job_type": job_type,
    "jobs_sample": jobs_sample,
    "job_runs_window": job_runs_window,
    "cluster_daily_metrics": cluster_daily_metrics,
    "run_totals": run_totals_query,
    "job_baselines": job_baselines_query,
    "job_baselines_bounded": job_baselines_bounded,
    "baselines_exclude_recent": baselines_exclude_recent,
    "baselines_20_days": baselines_20_days,
    "job_baselines_merged": job_baselines_merged,
    "success_rate": success_rate,
    "stability": stability_query,
    "job_health": job_health_query,
    "job_health_trend": job_health_trend,
    "job_utilisation": job_utilisation_query,
    "job_health_components": job_health_components,
    "recent_stats": recent_stats_query,
    "anomalies_t2": anomalies_t2,
    "anomalies_t1": anomalies_t1,
    "anomalies_run_grain": anomalies_run_grain,
    "failure_alerts": failure_alerts,
    "failure_alerts_all": failure_alerts_all,
    "failures_named_at_start": failures_named_at_start,
    "health_alerts": health_alerts,
    "health_alerts_all": health_alerts_all,
    "anomaly_alerts": anomaly_alerts,
    "alerts_routed": alerts_routed,
    "alert_payloads": alert_payloads_query,
    "alert_history": alert_history_query,
    "alert_counts": alert_counts,
    "alerts_rate_limited": alerts_rate_limited,
    "alerts_across_collections": alerts_across_collections,
    "alert_colours": alert_colours,
    "source_counts": source_counts,
    "source_probe": source_probe,
    "collection_counts": collection_counts,
    "collection_run_log": collection_run_log,
    "top_unhealthy": top_unhealthy,
    "recent_pipeline_runs": recent_pipeline_runs_query,
    "write_read_roundtrip": write_read_roundtrip,
    "metrics_5min": metrics_5min,
    "cost_daily": cost_daily,
    "cost_spikes": cost_spikes_query,
    "cost_alerts": cost_alerts,
    "costs_incremental": costs_incremental,
    "run_costs": run_costs_query,
    "cost_efficiency": cost_efficiency_query,
    "runs_upsert": runs_upsert,
    "runs_late_repaired": runs_late_repaired,
    "metrics_stream": metrics_stream,
    "runs_stream_dedup": runs_stream_dedup,
    "alert_cooldown_stream": alert_cooldown_stream,
    "failure_alerts_stream": failure_alerts_stream,
    "stream_batch_counts": stream_batch_counts,
}


def registered():
    """The queries, each run with UTC session time as the tables assume."""

    def in_utc(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, str(sf_dir).rstrip("/"))

        run.__name__ = query.__name__
        run.__doc__ = query.__doc__
        return run

    return {name: in_utc(query) for name, query in QUERIES.items()}
