"""Telemetry-shaped views over the generic test tables (orders, lineitem, events).

Each function derives one source table from columns of the given tables with a
fixed rule; there are no row filters, so work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
ORDERS_DAYS = 3650

EVENT_SLICE_COLUMNS = (
    "concat('ws-', user_id % 3) AS workspace_id",
    "concat('job-', user_id) AS job_id",
    "cast(event_id AS string) AS run_id",
    "'nightly' AS run_name",
    "'JOB_RUN' AS run_type",
    "'PERIODIC' AS trigger_type",
    "concat('u', user_id % 50, '@example.com') AS creator_email",
    "ts AS period_start_time",
    "ts + make_dt_interval(0, 0, 0, cast(planned_ms / 1000 AS decimal(18, 6)))"
    " AS period_end_time",
    "CASE WHEN event_type = 'error' AND value > 30 * (user_id % 6) THEN 'FAILED'"
    " WHEN event_type = 'signup' AND user_id % 7 = 0 THEN NULL ELSE 'SUCCESS' END"
    " AS result_state",
    "'TERMINATED' AS lifecycle_state",
    "CASE WHEN event_id % 2 = 0 THEN NULL ELSE props END AS state_message",
    "'DONE' AS termination_code",
)

PLANNED_MS = (
    "greatest(cast(0 AS bigint), cast(round(value * 1000) AS bigint)"
    " + CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 90000"
    " WHEN 3 THEN 150000 WHEN 4 THEN 300000 ELSE 1000000 END"
    " + CASE WHEN ts < TIMESTAMP_NTZ '2024-01-24 00:00:00' THEN 0"
    " WHEN user_id % 5 = 1 THEN 400000 WHEN user_id % 5 = 4 THEN -60000 ELSE 0 END)"
    " AS planned_ms"
)

SAMPLE_COLUMNS = (
    "concat('cl-', user_id % 20) AS cluster_id",
    "ts AS start_time",
    "least(value / 10, 60D) AS cpu_user_percent",
    "least(value / 20, 30D) AS cpu_system_percent",
    "100 - least(value / 10, 60D) - least(value / 20, 30D) AS cpu_idle_percent",
    "least(value / 5, 100D) AS mem_used_percent",
    "value * 1024 AS network_received_bytes",
    "value * 512 AS network_sent_bytes",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change record per order; the customer is the job."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('ws-', o_custkey % 3) AS workspace_id",
        "concat('job-', o_custkey) AS job_id",
        "o_orderdate AS change_time",
        "o_orderkey AS change_id",
        "concat('job ', o_orderkey) AS name",
        "concat('owner-', o_custkey % 10) AS owned_by",
        "concat('u', o_orderkey % 50, '@example.com') AS creator_email",
        "o_orderdate AS created_time",
        "named_struct("
        "'tasks', CASE WHEN o_orderpriority = '1-URGENT' THEN array('main') END,"
        "'notebook_task', CASE WHEN o_orderpriority = '2-HIGH' THEN 'nb' END,"
        "'python_wheel_task', CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'whl' END,"
        "'jar_task', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'jar' END"
        ") AS settings",
    )


def event_slices(events: DataFrame) -> DataFrame:
    """Run slices from an events frame, batch or streaming; one slice per event."""
    return events.selectExpr("*", PLANNED_MS).selectExpr(*EVENT_SLICE_COLUMNS)


def event_changes(events: DataFrame) -> DataFrame:
    """Metadata changes from an events frame, batch or streaming: every signup renames the user's job."""
    return events.where("event_type = 'signup'").selectExpr(
        "concat('ws-', user_id % 3) AS workspace_id",
        "concat('job-', user_id) AS job_id",
        "ts AS change_time",
        "event_id AS change_id",
        "concat('job ', event_id) AS name",
    )


def run_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-slice runs: every event is one run of its user's job."""
    return event_slices(table(spark, sf_dir, "events"))


def multi_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-slice runs: every order is a run, its line items are the slices."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).selectExpr(
        "concat('ws-', o_custkey % 3) AS workspace_id",
        "concat('job-', o_custkey) AS job_id",
        "cast(o_orderkey AS string) AS run_id",
        "o_orderdate AS period_start_time",
        "o_orderdate + make_dt_interval(0, 0, 0, cast(round(l_quantity * 60) AS decimal(18, 6)))"
        " AS period_end_time",
        "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS result_state",
    )


def event_samples(events: DataFrame) -> DataFrame:
    """Node samples from an events frame, batch or streaming."""
    return events.selectExpr(*SAMPLE_COLUMNS)


def node_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(table(spark, sf_dir, "events"))


def job_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every job that has runs."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "concat('ws-', user_id % 3) AS workspace_id",
            "concat('job-', user_id) AS job_id",
            "concat('cl-', user_id % 20) AS cluster_id",
        )
        .distinct()
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage record per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('ws-', o_custkey % 3) AS workspace_id",
        "concat('job-', o_custkey) AS job_id",
        "cast(o_orderdate AS date) AS usage_date",
        "o_totalprice AS usage_quantity",
    )
