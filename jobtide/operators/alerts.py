"""Alert rows from failures, low health, anomalies and cost spikes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.alert_text import display_name, error_text
from jobtide.functions.clock import AsOf, epoch_seconds, moment
from jobtide.operators.jobs import with_metadata_at
from jobtide.schemas import JOB_KEYS, TABLES


@dataclass(frozen=True)
class AlertRule:
    """From which value on an alert kind fires, how severe it is, and where it goes.

    ``channels=None`` means every configured channel. ``limit`` keeps the first alerts of the
    kind only, the newest failures or the lowest scores; by default all are kept.
    """

    threshold: float
    severity: str
    channels: tuple[str, ...] | None
    limit: int | None = None
    enabled: bool = True


# Default rules.
RULES = {
    "job_failure": AlertRule(1, "high", ("slack", "email")),
    "health_score_low": AlertRule(50, "medium", ("slack",)),
    "performance_anomaly": AlertRule(2.0, "medium", ("slack",)),
    "cost_spike": AlertRule(1.5, "high", ("slack", "email")),
}

ALERT_COLUMNS = tuple(f.name for f in TABLES["job_alerts"] if f.name != "channels_sent")


def no_alerts(spark: SparkSession) -> DataFrame:
    fields = [f for f in TABLES["job_alerts"] if f.name in ALERT_COLUMNS]
    return spark.createDataFrame([], type(TABLES["job_alerts"])(fields))


def _alert_rows(
    df: DataFrame,
    *,
    kind: str,
    id_prefix: str,
    rule: AlertRule,
    title: str,
    message: Column,
    metadata: Mapping[str, Column],
    created_at: Column,
    subject: Sequence[Column] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Alert columns over a frame that has the job keys and ``_name``.

    An id holds the workspace, the job, what else the alert is about (``subject``) and the second.
    """
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return df.withColumn("_at", created_at).select(
        F.concat_ws(
            "_",
            F.lit(id_prefix),
            "workspace_id",
            "job_id",
            *(c.cast("string") for c in subject),
            epoch_seconds(F.col("_at")).cast("string"),
        ).alias("id"),
        F.lit(kind).alias("alert_type"),
        F.lit(rule.severity).alias("severity"),
        F.concat(F.lit(f"{title}: "), "_name").alias("title"),
        message.alias("message"),
        "job_id",
        F.col("_name").alias("job_name"),
        "workspace_id",
        F.create_map(*pairs).alias("metadata"),
        F.col("_at").alias("created_at"),
        *extra,
    )


def _with_name(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``_name`` from the job metadata, which holds one row per job.

    A job with very many rows is split by Spark's skew handling: names are the unique side.
    """
    names = jobs.select(*JOB_KEYS, F.col("job_name").alias("_job_name"))
    return df.join(names, list(JOB_KEYS), "left").withColumn(
        "_name", display_name(F.col("_job_name"), F.col("job_id"))
    )


def failed_runs(runs: DataFrame) -> DataFrame:
    """Failed slices as alert candidates: run columns, ``alert_type``, ``created_at``."""
    return runs.where(F.col("result_state") == "FAILED").withColumns(
        {
            "alert_type": F.lit("job_failure"),
            "created_at": F.col("period_start_time").cast("timestamp"),
        }
    )


def failure_alerts(
    runs: DataFrame,
    jobs: DataFrame,
    as_of: AsOf = None,
    rule: AlertRule = RULES["job_failure"],
    at_event_time: bool = False,
    changes: DataFrame | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One alert per failed run; the newest of them where the rule has a limit.

    The limit comes before the join, so names are looked up for a handful of rows.
    ``at_event_time`` stamps alerts with the run's start instead of ``as_of``. With ``changes``, the change log,
    an alert carries the name that its job had when the run started, in place of that in ``jobs``.
    """
    if not rule.enabled:
        return no_alerts(runs.sparkSession)
    failed = runs.where(F.col("result_state") == "FAILED").select(
        *JOB_KEYS, "run_id", "period_start_time", "state_message"
    )
    if rule.limit is not None:
        failed = failed.orderBy(
            F.col("period_start_time").desc(), *JOB_KEYS, "run_id", "state_message"
        ).limit(rule.limit)
    if changes is None:
        named = _with_name(failed, jobs)
    else:
        dated = with_metadata_at(failed, changes, "period_start_time", ("name",), tie_break)
        named = dated.withColumn("_name", display_name(F.col("name"), F.col("job_id")))
    created = F.col("period_start_time").cast("timestamp") if at_event_time else moment(as_of)
    return failure_rows(named, rule, created)


def failure_rows(named: DataFrame, rule: AlertRule, created_at: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Alerts over failed slices that have the ``_name`` of their job, a batch or a stream; ``extra`` columns stay."""
    named = named.withColumn("_error", error_text(F.col("state_message")))
    return _alert_rows(
        named,
        kind="job_failure",
        id_prefix="job_failure",
        rule=rule,
        title="Job Failure",
        message=F.concat(
            F.lit("Job '"), "_name", F.lit("' has failed with error: "), "_error"
        ),
        metadata={"error_message": F.col("_error"), "rule_threshold": F.lit(str(rule.threshold))},
        created_at=created_at,
        subject=[
            F.col("run_id"),
            F.unix_millis(F.col("period_start_time").cast("timestamp")),
        ],
        extra=extra,
    )


def health_alerts(
    health: DataFrame,
    as_of: AsOf = None,
    rule: AlertRule = RULES["health_score_low"],
) -> DataFrame:
    """One alert per job scoring below the rule's threshold; the lowest where it has a limit."""
    if not rule.enabled:
        return no_alerts(health.sparkSession)
    name = display_name(F.col("job_name"), F.col("job_id"))
    named = health.where(F.col("health_score") < rule.threshold).select(
        *JOB_KEYS, "health_score", name.alias("_name")
    )
    if rule.limit is not None:
        named = named.orderBy("health_score", *JOB_KEYS).limit(rule.limit)
    return _alert_rows(
        named,
        kind="health_score_low",
        id_prefix="health_low",
        rule=rule,
        title="Low Health Score",
        message=F.concat(
            F.lit("Job '"),
            "_name",
            F.lit("' has a health score of "),
            F.format_string("%.1f", "health_score"),
            F.lit(f", below threshold of {rule.threshold}"),
        ),
        metadata={
            "health_score": F.col("health_score"),
            "threshold": F.lit(str(rule.threshold)),
        },
        created_at=moment(as_of),
    )


def anomaly_alerts(
    found: DataFrame,
    jobs: DataFrame,
    as_of: AsOf = None,
    rule: AlertRule = RULES["performance_anomaly"],
) -> DataFrame:
    """One alert per anomaly whose score exceeds the rule's threshold."""
    if not rule.enabled:
        return no_alerts(found.sparkSession)
    named = _with_name(found.where(F.col("anomaly_score") > rule.threshold), jobs)
    return _alert_rows(
        named,
        kind="performance_anomaly",
        id_prefix="anomaly",
        rule=rule,
        title="Performance Anomaly",
        message=F.concat(
            F.lit("Job '"),
            "_name",
            F.lit("' runs "),
            "anomaly_type",
            F.lit(" with an anomaly score of "),
            F.format_string("%.1f", "anomaly_score"),
        ),
        metadata={
            "anomaly_type": F.col("anomaly_type"),
            "anomaly_score": F.round("anomaly_score", 3),
            "threshold": F.lit(str(rule.threshold)),
        },
        created_at=moment(as_of),
    )


def cost_alerts(
    spikes: DataFrame,
    jobs: DataFrame,
    as_of: AsOf = None,
    rule: AlertRule = RULES["cost_spike"],
) -> DataFrame:
    """One alert per job and day whose usage exceeds the threshold times its average."""
    if not rule.enabled:
        return no_alerts(spikes.sparkSession)
    named = _with_name(spikes.where(F.col("cost_ratio") > rule.threshold), jobs)
    return _alert_rows(
        named,
        kind="cost_spike",
        id_prefix="cost_spike",
        rule=rule,
        title="Cost Spike",
        message=F.concat(
            F.lit("Job '"),
            "_name",
            F.lit("' used "),
            F.format_string("%.1f", "cost_ratio"),
            F.lit(" times its average on "),
            F.col("usage_date").cast("string"),
        ),
        metadata={
            "usage_date": F.col("usage_date"),
            "cost_ratio": F.round("cost_ratio", 3),
            "threshold": F.lit(str(rule.threshold)),
        },
        created_at=F.col("usage_date").cast("timestamp") if as_of is None else moment(as_of),
        subject=[F.col("usage_date")],
    )


def combine_alerts(kinds: Iterable[DataFrame], enabled: bool = True) -> DataFrame:
    """All alert kinds in one frame; no rows when alerting is disabled."""
    kinds = list(kinds)
    if not enabled:
        return no_alerts(kinds[0].sparkSession)
    return reduce(DataFrame.unionByName, kinds)


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Number of alerts per kind."""
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alert_count"))
