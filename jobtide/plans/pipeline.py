"""A whole collection: sources to result tables, alerts and run log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from jobtide.functions.clock import column_type, days_before, moment, within_calendar_days, within_days
from jobtide.functions.scores import HEALTH_WEIGHTS
from jobtide.operators.alerts import (
    RULES,
    AlertRule,
    alert_counts,
    anomaly_alerts,
    combine_alerts,
    cost_alerts,
    failure_alerts,
    health_alerts,
)
from jobtide.operators.anomalies import RECENT_DAYS, Z_LIMIT, job_anomalies
from jobtide.operators.baselines import job_baselines
from jobtide.operators.costs import cost_spikes, costs_since, daily_costs
from jobtide.operators.health import duration_trend, job_health
from jobtide.operators.jobs import latest_jobs, latest_per_key
from jobtide.operators.limits import (
    COOLDOWN_MINUTES,
    MAX_PER_DAY,
    MAX_PER_HOUR,
)
from jobtide.operators.metrics import daily_metrics, window_metrics
from jobtide.operators.runcosts import cost_efficiency, run_costs
from jobtide.operators.runs import job_runs, project_runs
from jobtide.operators.sketches import duration_days, merged_baselines
from jobtide.operators.utilisation import SAMPLE_SECONDS, job_utilisation
from jobtide.schemas import JOB_KEYS, SLICE_KEYS
from jobtide.sinks.alertlog import append_history, marked_alerts
from jobtide.sinks.runlog import append_run_log, run_record
from jobtide.sinks.store import Store
from jobtide.sinks.upsert import (
    VERSION,
    high_water_mark,
    newer_slices,
    stored_runs,
    upsert_partitions,
    upsert_runs,
)
from jobtide.sources.probe import require_sources

#: What a collection can do about late slices, and the name it counts them under.
LATE_RUNS = ("count", "repair", "ignore")
LATE = "late_slices"


@dataclass(frozen=True)
class Settings:
    """Windows, limits and rules of a collection.

    ``components`` names the fixed parts of the health score that are computed instead: ``trend_analysis``,
    ``resource_utilization`` (which needs a source ``job_clusters``) and ``cost_efficiency``.
    ``late_runs`` says what incremental runs without a change column do about slices of the window that came or changed
    after the overlap: "count" them into the run record, "repair" the run table with them, or "ignore" them,
    which saves a scan of the window.
    """

    collection_window_days: int = 30
    metrics_days: int = 7
    baseline_days: int = 30
    recent_days: int = RECENT_DAYS
    exclude_recent_days: int = 0
    grain: str = "slice"
    min_runs: int = 5
    threshold: float = Z_LIMIT
    weights: Mapping[str, float] = field(default_factory=lambda: dict(HEALTH_WEIGHTS))
    rules: Mapping[str, AlertRule] = field(default_factory=lambda: dict(RULES))
    alerting_enabled: bool = True
    names_at_start: bool = False
    anomaly_alerts: bool = False
    costs: bool = False
    cost_alert_days: int = 1
    channels: Sequence[str] = ()
    tie_break: Sequence[str] = ()
    environment: str = "development"
    components: Sequence[str] = ()
    sample_seconds: int = SAMPLE_SECONDS
    sketch_baselines: bool = False
    incremental_runs: bool = False
    overlap_days: int = 1
    changed_column: str | None = None
    late_runs: str = "count"
    metrics_width: str | None = None
    rate_limits: bool = False
    cooldown_minutes: int = COOLDOWN_MINUTES
    max_per_hour: int = MAX_PER_HOUR
    max_per_day: int = MAX_PER_DAY

    def __post_init__(self):
        if self.late_runs not in LATE_RUNS:
            raise ValueError(f"late_runs is {self.late_runs!r}, not one of {', '.join(LATE_RUNS)}")


def require_utc(spark: SparkSession) -> None:
    """All moments are naive UTC; a session in another zone would shift every window."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}, not UTC")


def fixed_as_of(as_of=None) -> str:
    """One moment for a whole collection: the given one, or now, as UTC text."""
    moment = as_of or datetime.now(UTC).replace(tzinfo=None)
    return str(moment)


def collect_tables(
    store: Store, sources: Mapping[str, DataFrame], as_of: str, settings: Settings
) -> dict[str, tuple[int, DataFrame]]:
    """Compute and write the result tables; row count and frame of each.

    Six of them, and ``job_costs`` where the settings ask for costs.

    Every stage reads its inputs back from the tables just written, so nothing is
    computed twice and a lost executor costs one stage. A stage without rows leaves an
    empty table: what a former collection found does not stand on.
    With ``incremental_runs`` the run table is kept by date and only brought up to
    date, and later stages read the window's partitions of it.
    """
    done: dict[str, tuple[int, DataFrame]] = {}

    def stage(table: str, df: DataFrame) -> DataFrame:
        rows = store.write(df, table)
        kept = store.read(table)
        done[table] = (rows, kept)
        return kept

    s = settings
    slices = sources["run_slices"]
    jobs = stage("jobs_metadata", latest_jobs(sources["job_changes"], as_of, s.tie_break))
    if s.incremental_runs:
        rows = collect_incremental(
            store, slices, as_of, s.collection_window_days, s.overlap_days, s.changed_column
        )
        runs = stored_runs(store, as_of, s.collection_window_days)
        if s.late_runs != "ignore" and not s.changed_column:
            look = collect_late if s.late_runs == "repair" else late_slices
            late = look(store, slices, as_of, s.overlap_days, s.collection_window_days)
            runs = stored_runs(store, as_of, s.collection_window_days)
            done[LATE] = (late, runs)
        done["job_runs"] = (rows, runs)
    else:
        window = job_runs(slices, as_of, s.collection_window_days)
        runs = stage("job_runs", window)
    stage("job_metrics", daily_metrics(sources["node_samples"], as_of, s.metrics_days))
    if s.metrics_width:
        samples = sources["node_samples"]
        recent = samples.where(within_calendar_days(samples, "start_time", as_of, s.metrics_days))
        stage("job_window_metrics", window_metrics(recent, s.metrics_width))
    covered = s.baseline_days <= s.collection_window_days
    if s.sketch_baselines:
        rows = collect_duration_days(store, slices, as_of, s.baseline_days, s.overlap_days)
        done["job_duration_days"] = (rows, store.read("job_duration_days"))
        found = merged_baselines(
            done["job_duration_days"][1], as_of, s.baseline_days, s.min_runs, s.exclude_recent_days
        )
    else:
        found = job_baselines(
            runs if covered else slices,
            as_of,
            s.baseline_days,
            s.min_runs,
            exclude_recent_days=s.exclude_recent_days,
        )
    baselines = stage("job_baselines", found)
    parts = {}
    if "trend_analysis" in s.components:
        parts["trend_analysis"] = duration_trend(runs)
    if "resource_utilization" in s.components:
        samples = sources["node_samples"]
        recent = samples.where(within_days(samples, "start_time", as_of, s.collection_window_days + 1))
        used = job_utilisation(runs, recent, sources["job_clusters"], s.sample_seconds)
        parts["resource_utilization"] = stage("job_utilisation", used)
    if "cost_efficiency" in s.components:
        usage = sources["usage"]
        recent = usage.where(within_calendar_days(usage, "usage_date", as_of, s.collection_window_days))
        parts["cost_efficiency"] = cost_efficiency(stage("run_costs", run_costs(runs, recent)))
    stage("job_health", job_health(jobs, runs, baselines, as_of, s.weights, parts))
    stage(
        "job_anomalies",
        job_anomalies(runs, baselines, as_of, s.threshold, s.recent_days, s.grain),
    )
    if s.costs:
        rows = collect_costs(store, sources["usage"], as_of, s.overlap_days)
        done["job_costs"] = (rows, store.read("job_costs"))
    return done


def collect_alerts(
    tables: Mapping[str, DataFrame], as_of: str, settings: Settings, changes: DataFrame | None = None
) -> DataFrame:
    """All alerts of one collection, from its result tables.

    With ``names_at_start``, failures carry the name that ``changes`` has for the start of the run.
    """
    rules = settings.rules
    jobs = tables["jobs_metadata"]
    dated = changes if settings.names_at_start else None
    kinds = [
        failure_alerts(
            tables["job_runs"], jobs, as_of, rules["job_failure"], changes=dated, tie_break=settings.tie_break
        ),
        health_alerts(tables["job_health"], as_of, rules["health_score_low"]),
    ]
    if settings.anomaly_alerts:
        found = tables["job_anomalies"]
        kinds.append(anomaly_alerts(found, jobs, as_of, rules["performance_anomaly"]))
    if settings.costs:
        costs = tables["job_costs"]
        recent = within_calendar_days(costs, "usage_date", as_of, settings.cost_alert_days)
        rule = rules["cost_spike"]
        spikes = cost_spikes(costs.where(recent), rule.threshold)
        kinds.append(cost_alerts(spikes, jobs, as_of, rule))
    return combine_alerts(kinds, settings.alerting_enabled)


def alert_limits(settings: Settings) -> dict[str, int] | None:
    """Arguments of ``rate_limited``, or None without rate limits."""
    names = ("cooldown_minutes", "max_per_hour", "max_per_day")
    return {n: getattr(settings, n) for n in names} if settings.rate_limits else None


def known_days(settings: Settings) -> int:
    """How far back an alert of a collection can have been made before, in dates."""
    return 1 + max(settings.collection_window_days, settings.cost_alert_days)


def run_collection(
    store: Store,
    loaders: Mapping[str, Callable[[], DataFrame]],
    as_of=None,
    settings: Settings = Settings(),
) -> dict:
    """Probe sources, write all tables, record alerts, append and return the run record.

    Alerts that the history has already are neither counted as sent nor stored again, and what earlier
    collections sent counts for the rate limits. A failure is logged as a failed run and raised again.
    """
    run_id, started = str(uuid.uuid4()), datetime.now(UTC)
    facts = {
        "run_id": run_id,
        "start_time": started,
        "environment": settings.environment,
        "collection_window_days": settings.collection_window_days,
    }
    try:
        require_utc(store.spark)
        require_sources(store.spark, loaders)
        now = fixed_as_of(as_of)
        sources = {n: load() for n, load in loaders.items()}
        done = collect_tables(store, sources, now, settings)
        found = collect_alerts({t: df for t, (_, df) in done.items()}, now, settings, sources["job_changes"])
        alerts = marked_alerts(store, found, now, known_days(settings), alert_limits(settings)).persist()
        try:
            sent = {kind: 0 for kind in settings.rules}
            passed = alert_counts(alerts.where("suppressed_by is null"))
            sent.update({r["alert_type"]: r["alert_count"] for r in passed.collect()})
            append_history(store, alerts, settings.channels, settings.rules)
        finally:
            alerts.unpersist()
    except Exception as error:
        failed = run_record(
            **facts, status="failed", end_time=datetime.now(UTC), errors=[str(error)]
        )
        try:
            append_run_log(store, failed)
        except Exception as log_error:
            error.add_note(f"the failed run could not be logged: {log_error}")
        raise
    record = run_record(
        **facts,
        status="completed",
        end_time=datetime.now(UTC),
        records_processed={t: rows for t, (rows, _) in done.items()},
        tables_updated=[store.name_of(t) for t, (rows, _) in done.items() if rows and t != LATE],
        alerts_sent=sent,
    )
    append_run_log(store, record)
    return record


def collect_incremental(
    store: Store,
    slices: DataFrame,
    as_of=None,
    first_days: int = 30,
    overlap_days: int = 1,
    changed: str | None = None,
    table: str = "job_runs",
) -> int:
    """Bring the date-partitioned run table up to date; rows in the rewritten dates.

    The first call loads ``first_days``. Later ones read from the stored high-water mark and upsert
    the latest version of each slice. With ``changed``, a column of the source that says when
    a row came or changed, the mark is of that column, which is stored along, and no late change is missed.
    Without it the mark is the latest start and reaches back ``overlap_days``; changes later than
    that are found by ``late_slices`` and brought in by ``collect_late``.
    """
    now = fixed_as_of(as_of)
    kept = [changed] if changed else []
    column = changed or "period_start_time"
    if store.exists(table):
        mark = high_water_mark(
            store.read(table), column, None if changed else "run_date", as_of=now
        )
        new = newer_slices(slices, mark, 0 if changed else overlap_days, column)
        new = new.where(F.col("period_start_time") <= moment(now, column_type(new, "period_start_time")))
    else:
        new = slices.where(within_days(slices, "period_start_time", now, first_days))
    fresh = project_runs(new, now, kept)
    return upsert_runs(store, latest_per_key(fresh, SLICE_KEYS, [*kept, *VERSION]), table)


def collect_duration_days(
    store: Store,
    slices: DataFrame,
    as_of=None,
    first_days: int = 30,
    overlap_days: int = 1,
    max_run_days: int = 2,
    table: str = "job_duration_days",
) -> int:
    """Bring the daily duration statistics up to ``as_of``; rows of the rewritten dates.

    The first call reads ``first_days``, later ones only the dates from ``overlap_days`` before the newest stored one.
    Slices are read from ``max_run_days`` earlier, so that runs are whole; a run that goes on for longer
    counts by its later slices.
    """
    now = fixed_as_of(as_of)
    mark = high_water_mark(store.read(table), "run_date", as_of=now) if store.exists(table) else None
    today = moment(now).cast("date")
    since = F.date_sub(today, first_days) if mark is None else F.date_sub(F.lit(mark).cast("date"), overlap_days)
    kind = column_type(slices, "period_start_time")
    start = F.col("period_start_time")
    read = slices.where((start >= F.date_sub(since, max_run_days).cast(kind)) & (start <= moment(now, kind)))
    days = duration_days(read).where(F.col("run_date") >= since)
    if not store.exists(table):
        return store.write(days, table, partition_by=["run_date"])
    return store.replace_partitions(days, table, ["run_date"])


def collect_costs(
    store: Store, usage: DataFrame, as_of=None, overlap_days: int = 1, table: str = "job_costs"
) -> int:
    """Bring the cost table, kept by month, up to ``as_of``; rows in the rewritten months.

    The first call reads all usage up to ``as_of``. Later ones read usage from ``overlap_days`` before the
    newest stored day on, and take the days before from the table, so trailing averages are the
    same as those over the whole usage. Usage that comes later than that stays out.
    """
    now = fixed_as_of(as_of)
    mark = high_water_mark(store.read(table), "usage_date", as_of=now) if store.exists(table) else None
    if mark is None:
        costs = daily_costs(usage, as_of=now)
    else:
        since = F.date_sub(F.lit(mark).cast("date"), overlap_days)
        costs = costs_since(usage, store.read(table), since, now)
    monthly = costs.withColumn("usage_month", F.date_format("usage_date", "yyyy-MM"))
    if not store.exists(table):
        return store.write(monthly, table, partition_by=["usage_month"])
    return upsert_partitions(store, table, monthly, [*JOB_KEYS, "usage_date"], "usage_month")


def late_rows(
    store: Store,
    slices: DataFrame,
    as_of=None,
    overlap_days: int = 1,
    days: int | None = None,
    table: str = "job_runs",
) -> DataFrame:
    """Source slices older than the overlap that the stored table lacks, or has in an older version only.

    A stored version is older if it ends earlier, or ends at the same moment without a state where the source has
    one. Of several versions in the source the latest counts. ``days`` bounds the scan of both sides; without it they are
    read from the first stored start on.
    """
    now = fixed_as_of(as_of)
    mark = high_water_mark(store.read(table), partition="run_date", as_of=now)
    if mark is None:
        return slices.where(F.lit(False))
    start = F.col("period_start_time")
    older = slices.where(start < days_before(slices, "period_start_time", mark, overlap_days))
    if days is None:
        stored = store.read(table)
        first = stored.agg(F.min("period_start_time")).first()[0]
        older = older.where(start >= F.lit(first))
    else:
        stored = stored_runs(store, now, days, table)
        older = older.where(within_days(older, "period_start_time", now, days))
    older = latest_per_key(older, SLICE_KEYS, ["period_end_time", "result_state"])
    known = stored.select(*(F.col(k).alias(f"_{k}") for k in (*SLICE_KEYS, "period_end_time", "result_state")))
    same = reduce(and_, (older[k].eqNullSafe(known[f"_{k}"]) for k in SLICE_KEYS))
    end, state = older["period_end_time"], older["result_state"]
    finished = state.isNull() | known["_result_state"].isNotNull()
    newer = (known["_period_end_time"] > end) | ((known["_period_end_time"] == end) & finished)
    unfinished = end.isNull() & (known["_period_end_time"].isNotNull() | finished)
    return older.join(known, same & F.coalesce(newer | unfinished, unfinished), "left_anti")


def late_slices(
    store: Store,
    slices: DataFrame,
    as_of=None,
    overlap_days: int = 1,
    days: int | None = None,
    table: str = "job_runs",
) -> int:
    """How many source slices came or changed after the overlap had passed them; see ``late_rows``."""
    return late_rows(store, slices, as_of, overlap_days, days, table).count()


def collect_late(
    store: Store,
    slices: DataFrame,
    as_of=None,
    overlap_days: int = 1,
    days: int | None = None,
    table: str = "job_runs",
) -> int:
    """Bring the late slices into the run table too; how many there were."""
    now = fixed_as_of(as_of)
    late = project_runs(late_rows(store, slices, now, overlap_days, days, table), now)
    late = late.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = late.count()
        if rows:
            upsert_runs(store, late, table, VERSION)
        return rows
    finally:
        late.unpersist()
