"""Declared schemas of the source and result tables, and the projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

JOB_KEYS = ("workspace_id", "job_id")
RUN_KEYS = (*JOB_KEYS, "run_id")
SLICE_KEYS = (*RUN_KEYS, "period_start_time")


STRING, DOUBLE, LONG, TIME = StringType(), DoubleType(), LongType(), TimestampType()


def _schema(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# The input columns the analysis reads.
SOURCES = {
    "job_changes": _schema(
        workspace_id=STRING,
        job_id=STRING,
        change_time=TIME,
        name=STRING,
        owned_by=STRING,
        creator_email=STRING,
        created_time=TIME,
        settings=_schema(
            tasks=ArrayType(STRING),
            notebook_task=STRING,
            python_wheel_task=STRING,
            jar_task=STRING,
        ),
    ),
    "run_slices": _schema(
        workspace_id=STRING,
        job_id=STRING,
        run_id=STRING,
        run_name=STRING,
        run_type=STRING,
        trigger_type=STRING,
        creator_email=STRING,
        period_start_time=TIME,
        period_end_time=TIME,
        result_state=STRING,
        lifecycle_state=STRING,
        state_message=STRING,
        termination_code=STRING,
    ),
    "node_samples": _schema(
        cluster_id=STRING,
        start_time=TIME,
        cpu_user_percent=DOUBLE,
        cpu_system_percent=DOUBLE,
        cpu_idle_percent=DOUBLE,
        mem_used_percent=DOUBLE,
        network_received_bytes=DOUBLE,
        network_sent_bytes=DOUBLE,
    ),
    "usage": _schema(
        workspace_id=STRING,
        job_id=STRING,
        usage_date=DateType(),
        usage_quantity=DOUBLE,
    ),
}

# The result tables with their column names and types.
TABLES = {
    "jobs_metadata": _schema(
        workspace_id=STRING,
        job_id=STRING,
        job_name=STRING,
        owned_by=STRING,
        creator_email=STRING,
        created_time=TIME,
        job_type=STRING,
        collected_at=TIME,
    ),
    "job_runs": _schema(
        workspace_id=STRING,
        job_id=STRING,
        run_id=STRING,
        run_name=STRING,
        run_type=STRING,
        trigger_type=STRING,
        creator_email=STRING,
        period_start_time=TIME,
        period_end_time=TIME,
        result_state=STRING,
        lifecycle_state=STRING,
        state_message=STRING,
        termination_code=STRING,
        duration_ms=LONG,
        collected_at=TIME,
    ),
    "job_metrics": _schema(
        cluster_id=STRING,
        day=DateType(),
        avg_cpu_usage_percent=DOUBLE,
        avg_cpu_idle_percent=DOUBLE,
        avg_memory_usage_percent=DOUBLE,
        avg_network_bytes=DOUBLE,
        metric_points=LONG,
        collected_at=TIME,
    ),
    "job_baselines": _schema(
        workspace_id=STRING,
        job_id=STRING,
        total_runs=LONG,
        avg_duration_ms=DOUBLE,
        stddev_duration_ms=DOUBLE,
        median_duration_ms=DOUBLE,
        p90_duration_ms=DOUBLE,
        min_duration_ms=DOUBLE,
        max_duration_ms=DOUBLE,
        upper_threshold_ms=DOUBLE,
        lower_threshold_ms=DOUBLE,
        coefficient_of_variation=DOUBLE,
        calculated_at=TIME,
    ),
    "job_health": _schema(
        workspace_id=STRING,
        job_id=STRING,
        job_name=STRING,
        owned_by=STRING,
        total_runs=LONG,
        successful_runs=LONG,
        health_score=DOUBLE,
        health_category=STRING,
        requires_attention=BooleanType(),
        success_rate=DOUBLE,
        success_rate_score=DOUBLE,
        stability_score=DOUBLE,
        coefficient_of_variation=DOUBLE,
        calculated_at=TIME,
    ),
    "job_anomalies": _schema(
        workspace_id=STRING,
        job_id=STRING,
        anomaly_type=STRING,
        anomaly_score=DOUBLE,
        recent_avg_duration=DOUBLE,
        avg_duration_ms=DOUBLE,
        z_score=DOUBLE,
        detected_at=TIME,
    ),
    "job_costs": _schema(
        workspace_id=STRING,
        job_id=STRING,
        usage_date=DateType(),
        usage=DOUBLE,
        trailing_avg=DOUBLE,
        cost_ratio=DOUBLE,
    ),
    "job_alerts": _schema(
        id=STRING,
        alert_type=STRING,
        severity=STRING,
        title=STRING,
        message=STRING,
        job_id=STRING,
        job_name=STRING,
        workspace_id=STRING,
        metadata=MapType(STRING, STRING),
        created_at=TIME,
        channels_sent=ArrayType(STRING),
    ),
    "pipeline_runs": _schema(
        run_id=STRING,
        status=STRING,
        start_time=TIME,
        end_time=TIME,
        duration_seconds=LONG,
        records_processed=STRING,
        tables_updated=LONG,
        alerts_sent=STRING,
        errors=STRING,
        environment=STRING,
        collection_window_days=IntegerType(),
    ),
}


def conform(
    df: DataFrame,
    schema: StructType,
    *,
    fill_missing: bool = False,
    keep_extra: bool = False,
) -> DataFrame:
    """Project ``df`` onto ``schema``: its columns, in its order, cast to its types.

    A missing column is an error unless ``fill_missing`` asks for nulls instead;
    other columns go unless ``keep_extra`` appends them.
    """
    missing = {f.name for f in schema} - set(df.columns)
    if missing and not fill_missing:
        raise ValueError(f"columns missing for the declared schema: {sorted(missing)}")
    typed = [
        (F.lit(None) if f.name in missing else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    extra = [c for c in df.columns if c not in schema.names] if keep_extra else []
    return df.select(*typed, *extra)
