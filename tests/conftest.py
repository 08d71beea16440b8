import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

AS_OF = "2024-01-31 00:00:00"
NOW = datetime(2024, 1, 31)
SF = "/root/testdata/sf0.001"

SLICE_SCHEMA = (
    "workspace_id string, job_id string, run_id string, run_name string, run_type string,"
    " trigger_type string, creator_email string, period_start_time timestamp_ntz,"
    " period_end_time timestamp_ntz, result_state string, lifecycle_state string,"
    " state_message string, termination_code string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("jobtide-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def slices(spark):
    """Build run slices from (job, run, days before now, minutes, state[, message])."""

    def build(*rows):
        out = []
        for job, run, days, minutes, state, *message in rows:
            start = NOW - timedelta(days=days)
            end = start + timedelta(minutes=minutes)
            text = message[0] if message else None
            out.append(
                ("w", job, run, "n", "JOB_RUN", "PERIODIC", "u@x", start, end, state,
                 "TERMINATED", text, "DONE")
            )
        return spark.createDataFrame(out, SLICE_SCHEMA)

    return build


@pytest.fixture
def jobs(spark):
    def build(*names):
        rows = [("w", f"j{i}", name, "o") for i, name in enumerate(names, 1)]
        return spark.createDataFrame(
            rows, "workspace_id string, job_id string, job_name string, owned_by string"
        )

    return build


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
