"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

J = """
j AS (
  SELECT 'ws-' || (o_custkey % 3) AS workspace_id, 'job-' || o_custkey AS job_id,
         o_orderdate AS change_time, o_orderkey AS change_id, 'job ' || o_orderkey AS job_name,
         'owner-' || (o_custkey % 10) AS owned_by,
         'u' || (o_orderkey % 50) || '@example.com' AS creator_email,
         o_orderdate AS created_time,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'MULTI_TASK' WHEN '2-HIGH' THEN 'NOTEBOOK'
              WHEN '3-MEDIUM' THEN 'PYTHON_WHEEL' WHEN '4-NOT SPECIFIED' THEN 'JAR'
              ELSE 'UNKNOWN' END AS job_type
  FROM orders
),
jobs AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY workspace_id, job_id
                                 ORDER BY change_time DESC, change_id DESC) AS rn
    FROM j)
  WHERE rn = 1
)"""

A = """
a0 AS (
  SELECT *, CAST(greatest(0, CAST(round(value * 1000) AS BIGINT)
      + CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 90000
             WHEN 3 THEN 150000 WHEN 4 THEN 300000 ELSE 1000000 END
      + CASE WHEN ts < TIMESTAMP '2024-01-24 00:00:00' THEN 0
             WHEN user_id % 5 = 1 THEN 400000 WHEN user_id % 5 = 4 THEN -60000 ELSE 0 END)
      AS BIGINT) AS duration_ms
  FROM events
),
a AS (
  SELECT 'ws-' || (user_id % 3) AS workspace_id, 'job-' || user_id AS job_id,
         CAST(event_id AS VARCHAR) AS run_id, 'nightly' AS run_name, 'JOB_RUN' AS run_type,
         'PERIODIC' AS trigger_type, 'u' || (user_id % 50) || '@example.com' AS creator_email,
         ts AS period_start_time,
         ts + duration_ms * INTERVAL '1 millisecond' AS period_end_time,
         CASE WHEN event_type = 'error' AND value > 30 * (user_id % 6) THEN 'FAILED'
              WHEN event_type = 'signup' AND user_id % 7 = 0 THEN NULL
              ELSE 'SUCCESS' END AS result_state,
         'TERMINATED' AS lifecycle_state,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE props END AS state_message,
         'DONE' AS termination_code, duration_ms
  FROM a0
)"""

B = """
b AS (
  SELECT 'ws-' || (o_custkey % 3) AS workspace_id, 'job-' || o_custkey AS job_id,
         CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS period_start_time,
         CAST(round(l_quantity * 60) AS BIGINT) * 1000 AS duration_ms,
         CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS result_state
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
)"""

N = """
n AS (
  SELECT 'cl-' || (user_id % 20) AS cluster_id, ts AS start_time,
         least(value / 10, 60) AS cpu_user, least(value / 20, 30) AS cpu_system,
         100 - least(value / 10, 60) - least(value / 20, 30) AS cpu_idle,
         least(value / 5, 100) AS mem, value * 1024 AS received, value * 512 AS sent
  FROM events
)"""

C = """
daily AS (
  SELECT 'ws-' || (o_custkey % 3) AS workspace_id, 'job-' || o_custkey AS job_id,
         CAST(o_orderdate AS DATE) AS usage_date, sum(o_totalprice) AS usage
  FROM orders GROUP BY 1, 2, 3
),
costs0 AS (
  SELECT *, avg(usage) OVER (PARTITION BY workspace_id, job_id ORDER BY usage_date
                             ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_avg
  FROM daily
),
costs AS (
  SELECT *, CASE WHEN trailing_avg > 0 THEN usage / trailing_avg END AS cost_ratio FROM costs0
)"""

B_WINDOW = "period_start_time >= TIMESTAMP '2001-08-02' - INTERVAL '3650 days'"
A_WINDOW = "period_start_time >= TIMESTAMP '2024-01-01'"


def baselines(source: str, where: str, name: str = "base") -> str:
    return f"""
totals AS (
  SELECT workspace_id, job_id, run_id, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms
  FROM {source} WHERE {where} AND result_state = 'SUCCESS' GROUP BY 1, 2, 3
),
stats AS (
  SELECT workspace_id, job_id, count(*) AS total_runs, avg(total_duration_ms) AS av,
         stddev(total_duration_ms) AS sd, quantile_cont(total_duration_ms, 0.5) AS med,
         quantile_cont(total_duration_ms, 0.9) AS p90, min(total_duration_ms) AS lo,
         max(total_duration_ms) AS hi
  FROM totals GROUP BY 1, 2 HAVING count(*) >= 5
),
{name} AS (
  SELECT *, CASE WHEN av > 0 THEN coalesce(sd, 0) / av ELSE 0 END AS cv FROM stats
)"""


BASELINE_COLUMNS = """workspace_id, job_id, total_runs, round(av, 3) AS avg_duration_ms,
  round(sd, 3) AS stddev_duration_ms, round(CAST(med AS DOUBLE), 3) AS median_duration_ms,
  round(CAST(p90 AS DOUBLE), 3) AS p90_duration_ms, CAST(lo AS DOUBLE) AS min_duration_ms,
  CAST(hi AS DOUBLE) AS max_duration_ms,
  round(av + 2 * coalesce(sd, 0), 3) AS upper_threshold_ms,
  round(av - 2 * coalesce(sd, 0), 3) AS lower_threshold_ms,
  round(cv, 6) AS coefficient_of_variation"""

RATES = f"""
rates AS (
  SELECT *, CASE WHEN success_rate >= CAST(0.95 AS DOUBLE) THEN CAST(1.0 AS DOUBLE)
                 WHEN success_rate >= CAST(0.90 AS DOUBLE) THEN 0.9
                 WHEN success_rate >= CAST(0.80 AS DOUBLE) THEN 0.7
                 WHEN success_rate >= CAST(0.70 AS DOUBLE) THEN 0.5
                 ELSE 0.2 END AS success_rate_score
  FROM (
    SELECT workspace_id, job_id, count(*) AS total_runs,
           count(*) FILTER (WHERE result_state = 'SUCCESS') AS successful_runs,
           CAST(count(*) FILTER (WHERE result_state = 'SUCCESS') AS DOUBLE) / count(*)
             AS success_rate
    FROM a WHERE {A_WINDOW} GROUP BY 1, 2)
)"""

STABLE = """
stable AS (
  SELECT workspace_id, job_id, cv, CASE WHEN cv <= CAST(0.1 AS DOUBLE) THEN CAST(1.0 AS DOUBLE)
         WHEN cv <= CAST(0.2 AS DOUBLE) THEN 0.8 WHEN cv <= CAST(0.3 AS DOUBLE) THEN 0.6
         WHEN cv <= CAST(0.5 AS DOUBLE) THEN 0.4 ELSE 0.2 END AS stability_score
  FROM base
)"""


def health(
    trend: str = "CAST(0.6 AS DOUBLE)", extra_join: str = "", used: str = "CAST(0.7 AS DOUBLE)"
) -> str:
    return f"""
scored AS (
  SELECT workspace_id, job_id, job_name, owned_by, total_runs, successful_runs, success_rate,
         success_rate_score, stability_score, cv,
         (coalesce(success_rate_score, 0) * CAST(0.3 AS DOUBLE)
          + coalesce(stability_score, 0) * CAST(0.25 AS DOUBLE)
          + CAST(0.8 AS DOUBLE) * CAST(0.2 AS DOUBLE)
          + {used} * CAST(0.15 AS DOUBLE)
          + {trend} * CAST(0.1 AS DOUBLE)) * 100 AS score
  FROM jobs LEFT JOIN rates USING (workspace_id, job_id)
            LEFT JOIN stable USING (workspace_id, job_id) {extra_join}
),
health AS (
  SELECT *, CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good'
                 WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS health_category,
         score < 70 AS requires_attention
  FROM scored
)"""


A_BASE = baselines("a", A_WINDOW)
HEALTH = ",".join([J, A, A_BASE, RATES, STABLE, health()])

HEALTH_COLUMNS = f"""workspace_id, job_id, job_name, owned_by, total_runs, successful_runs,
  round(score, 6) AS health_score, health_category, requires_attention,
  round(success_rate, 6) AS success_rate, success_rate_score, stability_score,
  round(cv, 6) AS coefficient_of_variation, {AS_OF} AS calculated_at"""


def found(recent: str, threshold: float) -> str:
    return f"""
recent AS ({recent}),
z AS (
  SELECT workspace_id, job_id, recent_avg_duration, av,
         (recent_avg_duration - av) / greatest(sd, CAST(1.0 AS DOUBLE)) AS z_score
  FROM recent JOIN base USING (workspace_id, job_id)
),
found AS (
  SELECT *, CASE WHEN z_score > {threshold} THEN 'SLOW' WHEN z_score < -{threshold} THEN 'FAST'
            END AS anomaly_type, abs(z_score) AS anomaly_score
  FROM z WHERE abs(z_score) > {threshold}
)"""


RECENT_A = """SELECT workspace_id, job_id, avg(duration_ms) AS recent_avg_duration,
  count(*) AS recent_run_count FROM a WHERE period_start_time >= TIMESTAMP '2024-01-24'
  GROUP BY 1, 2"""
RECENT_B = """SELECT workspace_id, job_id, avg(d) AS recent_avg_duration, count(*) AS n FROM (
  SELECT workspace_id, job_id, run_id, sum(duration_ms) AS d FROM b
  WHERE period_start_time >= TIMESTAMP '2001-08-02' - INTERVAL '365 days' GROUP BY 1, 2, 3)
  GROUP BY 1, 2"""


def anomaly_columns(as_of: str) -> str:
    return f"""workspace_id, job_id, anomaly_type, round(anomaly_score, 6) AS anomaly_score,
  round(recent_avg_duration, 3) AS recent_avg_duration, round(av, 3) AS avg_duration_ms,
  round(z_score, 6) AS z_score, {as_of} AS detected_at"""


FAILED = """
failed AS (
  SELECT a.*, coalesce(nullif(jobs.job_name, ''), 'Job ' || a.job_id) AS shown,
         coalesce(nullif(a.state_message, ''), 'Unknown error') AS err
  FROM a LEFT JOIN jobs USING (workspace_id, job_id)
  WHERE result_state = 'FAILED'
),
all_failures AS (
  SELECT 'job_failure_' || workspace_id || '_' || job_id || '_' || run_id || '_'
           || (epoch_us(period_start_time) // 1000) || '_' || CAST(floor(epoch(period_start_time)) AS BIGINT) AS id,
         'job_failure' AS alert_type, 'high' AS severity, 'Job Failure: ' || shown AS title,
         'Job ''' || shown || ''' has failed with error: ' || err AS message, job_id,
         shown AS job_name, workspace_id, period_start_time AS created_at,
         err AS error_message, '1' AS rule_threshold
  FROM failed
)"""

def top_failed(limit: str = "") -> str:
    return f"""
top_failed AS (
  SELECT * FROM failed ORDER BY period_start_time DESC, workspace_id, job_id, run_id {limit}
),
failures AS (
  SELECT 'job_failure_' || workspace_id || '_' || job_id || '_' || run_id || '_'
           || (epoch_us(period_start_time) // 1000) || '_1706659200' AS id, 'job_failure' AS alert_type,
         'high' AS severity, 'Job Failure: ' || shown AS title,
         'Job ''' || shown || ''' has failed with error: ' || err AS message, job_id,
         shown AS job_name, workspace_id, {AS_OF} AS created_at,
         err AS error_message, '1' AS rule_threshold
  FROM top_failed
)"""


def low(limit: str = "") -> str:
    return f"""
lowest AS (
  SELECT *, coalesce(nullif(job_name, ''), 'Job ' || job_id) AS shown FROM health
  WHERE score < 50 ORDER BY score, workspace_id, job_id {limit}
),
lows AS (
  SELECT 'health_low_' || workspace_id || '_' || job_id || '_1706659200' AS id, 'health_score_low' AS alert_type,
         'medium' AS severity, 'Low Health Score: ' || shown AS title,
         'Job ''' || shown || ''' has a health score of ' || printf('%.1f', score)
           || ', below threshold of 50' AS message,
         job_id, shown AS job_name, workspace_id, {AS_OF} AS created_at,
         CAST(score AS VARCHAR) AS health_score, '50' AS threshold
  FROM lowest
)"""

ALERTS = ",".join(
    [
        HEALTH,
        FAILED,
        top_failed(),
        low(),
        r"""
alerts AS (
  SELECT id, alert_type, severity, title, message, job_id, job_name, workspace_id, created_at,
         '{' || chr(10) || '  "error_message": ' || CAST(to_json(error_message) AS VARCHAR) || ','
             || chr(10) || '  "rule_threshold": ' || rule_threshold || chr(10) || '}' AS details
  FROM failures
  UNION ALL
  SELECT id, alert_type, severity, title, message, job_id, job_name, workspace_id, created_at,
         '{' || chr(10) || '  "health_score": ' || health_score || ','
             || chr(10) || '  "threshold": ' || threshold || chr(10) || '}'
  FROM lows
)""",
    ]
)

ALERT_LIST = "id, alert_type, severity, title, message, job_id, job_name, workspace_id, created_at"

METRICS = """round(avg(cpu_user + cpu_system), 8) AS avg_cpu_usage_percent,
  round(avg(cpu_idle), 8) AS avg_cpu_idle_percent, round(avg(mem), 8) AS avg_memory_usage_percent,
  round(avg(received + sent), 3) AS avg_network_bytes, count(*) AS metric_points"""

RUN_COLUMNS = """workspace_id, job_id, run_id, run_name, run_type, trigger_type, creator_email,
  period_start_time, period_end_time, result_state, lifecycle_state, state_message,
  termination_code, duration_ms"""

FIVE_MINUTES = f"""SELECT cluster_id, time_bucket(INTERVAL '5 minutes', start_time) AS window_start,
  time_bucket(INTERVAL '5 minutes', start_time) + INTERVAL '5 minutes' AS window_end, {METRICS}
  FROM n GROUP BY 1, 2, 3"""

COST_COLUMNS = """workspace_id, job_id, usage_date, round(usage, 6) AS usage,
  round(trailing_avg, 6) AS trailing_avg, round(cost_ratio, 6) AS cost_ratio"""

COUNTED = f"""{HEALTH}, {N}, {FAILED}, {found(RECENT_A, 2.0)}, {C.strip()},
counted AS (
  SELECT 1 AS place, 'jobs_metadata' AS name, count(*) AS row_count FROM jobs
  UNION ALL SELECT 2, 'job_runs', count(*) FROM a WHERE {A_WINDOW}
  UNION ALL SELECT 3, 'job_metrics', count(*) FROM (
    SELECT DISTINCT cluster_id, CAST(start_time AS DATE) FROM n WHERE start_time >= TIMESTAMP '2024-01-24')
  UNION ALL SELECT 4, 'job_window_metrics', count(*) FROM (
    SELECT DISTINCT cluster_id, time_bucket(INTERVAL '5 minutes', start_time) FROM n
    WHERE start_time >= TIMESTAMP '2024-01-24')
  UNION ALL SELECT 5, 'job_baselines', count(*) FROM base
  UNION ALL SELECT 6, 'job_health', count(*) FROM health
  UNION ALL SELECT 7, 'job_anomalies', count(*) FROM found
  UNION ALL SELECT 8, 'job_costs', count(*) FROM costs
  UNION ALL SELECT 9, 'job_failure', count(*) FROM failed WHERE {A_WINDOW}
  UNION ALL SELECT 10, 'health_score_low', count(*) FROM health WHERE score < 50
)"""

MIDWAY = "TIMESTAMP '1998-06-17 00:00:00'"
J_MIDWAY = J.replace("FROM orders", f"FROM orders WHERE o_orderdate <= {MIDWAY}", 1)

TREND = f"""
trend AS (
  SELECT workspace_id, job_id,
         coalesce(sign(regr_slope(duration_ms, floor(epoch(period_start_time)))), 0) AS t
  FROM a WHERE {A_WINDOW} GROUP BY 1, 2
)"""
TREND_SCORE = """(CASE WHEN t = -1 THEN CAST(1.0 AS DOUBLE) WHEN t = 1 THEN CAST(0.2 AS DOUBLE)
            ELSE CAST(0.6 AS DOUBLE) END)"""

# Every pair of a slice and a sample of its cluster that overlap, in microseconds.
UTILISED = f"""
pairs AS (
  SELECT workspace_id, job_id, cpu_user + cpu_system AS cpu,
         epoch_us(least(period_end_time, start_time + INTERVAL '600 seconds'))
           - epoch_us(greatest(period_start_time, start_time)) AS overlap
  FROM a JOIN n ON cluster_id = 'cl-' || (CAST(substr(job_id, 5) AS BIGINT) % 20)
       AND start_time < period_end_time AND start_time + INTERVAL '600 seconds' > period_start_time
  WHERE {A_WINDOW}
),
utilised AS (
  SELECT workspace_id, job_id, sum(overlap) / 1e6 AS covered, sum(overlap * cpu) / sum(overlap) AS busy
  FROM pairs GROUP BY 1, 2
),
with_slices AS (
  SELECT DISTINCT workspace_id, job_id FROM a WHERE {A_WINDOW} AND period_end_time > period_start_time
)"""

RUN_COSTS = """
whole AS (
  SELECT workspace_id, job_id, run_id, result_state,
         period_start_time + INTERVAL '1410 minutes' AS s,
         period_start_time + INTERVAL '1410 minutes' + duration_ms * INTERVAL '1 millisecond' AS e
  FROM b
),
cut AS (
  SELECT *, CAST(unnest(range(CAST(s AS DATE), CAST(e - INTERVAL '1 microsecond' AS DATE) + 1, INTERVAL '1 day')) AS DATE) AS usage_date
  FROM whole WHERE e > s
),
pieces AS (
  SELECT workspace_id, job_id, run_id, usage_date, bool_or(result_state = 'SUCCESS') AS succeeded,
         CAST(sum(epoch_ms(least(e, CAST(usage_date + 1 AS TIMESTAMP))) - epoch_ms(greatest(s, CAST(usage_date AS TIMESTAMP)))) AS BIGINT) AS run_ms
  FROM cut GROUP BY 1, 2, 3, 4
),
units AS (
  SELECT 'ws-' || (o_custkey % 3) AS workspace_id, 'job-' || o_custkey AS job_id, CAST(o_orderdate AS DATE) AS usage_date,
         CAST(round(sum(o_totalprice) * 1000000) AS HUGEINT) AS units
  FROM orders GROUP BY 1, 2, 3
),
upto AS (
  SELECT *, sum(run_ms) OVER (PARTITION BY workspace_id, job_id, usage_date) AS total,
         sum(run_ms) OVER (PARTITION BY workspace_id, job_id, usage_date ORDER BY substr(md5(run_id), 1, 2), run_id
                           ROWS UNBOUNDED PRECEDING) AS so_far
  FROM pieces WHERE run_ms > 0
),
shares AS (
  SELECT workspace_id, job_id, usage_date, run_id, run_ms, succeeded,
         CAST((units * so_far) // total - (units * (so_far - run_ms)) // total AS BIGINT) AS cost_units
  FROM upto JOIN units USING (workspace_id, job_id, usage_date)
  UNION ALL
  SELECT workspace_id, job_id, usage_date, NULL, 0, NULL, CAST(units AS BIGINT)
  FROM units ANTI JOIN upto USING (workspace_id, job_id, usage_date)
)"""


def collections(moments: list[str], cooldown: int, per_hour: int, per_day: int) -> str:
    """CTEs of what each collection adds to the alert history: failures since the one before, held to the limits."""
    parts, before = [], []
    for k, moment in enumerate(moments, 1):
        now = f"TIMESTAMP '{moment}'"
        since = f"period_start_time > TIMESTAMP '{moments[k - 2]}'" if k > 1 else f"period_start_time >= {now} - INTERVAL '30 days'"
        earlier = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in before) or "SELECT * FROM none"
        parts.append(f"""
e{k} AS ({earlier}),
n{k} AS (
  SELECT id || '_' || CAST(epoch({now}) AS BIGINT) AS id, workspace_id, job_id, {now} AS created_at,
         row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY id) = 1
         AND NOT EXISTS (SELECT 1 FROM e{k} WHERE e{k}.workspace_id = f.workspace_id AND e{k}.job_id = f.job_id
                         AND e{k}.created_at > {now} - INTERVAL '{cooldown} minutes') AS quiet
  FROM f WHERE {since} AND period_start_time <= {now}
),
h{k} AS (
  SELECT *, quiet AND row_number() OVER (PARTITION BY quiet ORDER BY workspace_id, job_id, id)
            <= {per_hour} - (SELECT count(*) FROM e{k} WHERE date_trunc('hour', created_at) = date_trunc('hour', {now})) AS in_hour
  FROM n{k}
),
d{k} AS (
  SELECT *, in_hour AND row_number() OVER (PARTITION BY in_hour ORDER BY workspace_id, job_id, id)
            <= {per_day} - (SELECT count(*) FROM e{k} WHERE date_trunc('day', created_at) = date_trunc('day', {now})) AS in_day
  FROM h{k}
),
s{k} AS (SELECT workspace_id, job_id, created_at FROM d{k} WHERE in_day)""")
        before.append(k)
    rows = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in before)
    return ",".join(parts) + f""",
history AS (
  SELECT id, workspace_id, job_id, created_at,
         CASE WHEN NOT quiet THEN 'cooldown' WHEN NOT in_hour THEN 'hour' WHEN NOT in_day THEN 'day' END AS suppressed_by,
         CAST(created_at AS DATE) AS alert_date
  FROM ({rows})
)"""


COLLECTIONS = ["2024-01-20 00:00:00", "2024-01-20 00:05:00", "2024-01-20 11:00:00", "2024-01-20 12:30:00"]

ORACLE = {
    "jobs_latest": f"""WITH {J} SELECT workspace_id, job_id, job_name, owned_by, creator_email,
  created_time, {AS_OF} AS collected_at FROM jobs""",
    "jobs_latest_midway": f"""WITH {J_MIDWAY} SELECT workspace_id, job_id, job_name, owned_by, creator_email,
  created_time, job_type, {MIDWAY} AS collected_at FROM jobs""",
    "job_type": f"WITH {J} SELECT workspace_id, job_id, job_type FROM jobs",
    "jobs_sample": f"""WITH {J} SELECT workspace_id, job_id, job_name, owned_by, created_time
  FROM jobs ORDER BY workspace_id, job_id LIMIT 10""",
    "job_runs_window": f"""WITH {A} SELECT {RUN_COLUMNS}, {AS_OF} AS collected_at FROM a
  WHERE period_start_time >= TIMESTAMP '2024-01-17'""",
    "cluster_daily_metrics": f"""WITH {N} SELECT cluster_id, CAST(start_time AS DATE) AS day,
  {METRICS}, {AS_OF} AS collected_at FROM n WHERE start_time >= TIMESTAMP '2024-01-24'
  GROUP BY 1, 2""",
    "run_totals": f"""WITH {B} SELECT workspace_id, job_id, run_id,
  CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM b
  WHERE {B_WINDOW} AND result_state = 'SUCCESS' GROUP BY 1, 2, 3""",
    "job_baselines": f"""WITH {B}, {baselines("b", B_WINDOW)} SELECT {BASELINE_COLUMNS},
  TIMESTAMP '2001-08-02 00:00:00' AS calculated_at FROM base""",
    "job_baselines_bounded": f"""WITH {B}, {baselines("b", B_WINDOW)} SELECT {BASELINE_COLUMNS},
  TIMESTAMP '2001-08-02 00:00:00' AS calculated_at FROM base""",
    "baselines_exclude_recent": f"""WITH {A}, {baselines("a", A_WINDOW
        + " AND period_start_time < TIMESTAMP '2024-01-24'")} SELECT {BASELINE_COLUMNS},
  {AS_OF} AS calculated_at FROM base""",
    "baselines_20_days": f"""WITH {A}, {baselines("a", "period_start_time >= TIMESTAMP '2024-01-11'")}
SELECT {BASELINE_COLUMNS}, {AS_OF} AS calculated_at FROM base""",
    "job_baselines_merged": f"""WITH {A}, {baselines("a", A_WINDOW).replace("quantile_cont", "quantile_disc")}
SELECT {BASELINE_COLUMNS}, {AS_OF} AS calculated_at FROM base""",
    "success_rate": f"""WITH {A}, {RATES} SELECT workspace_id, job_id, total_runs, successful_runs,
  round(success_rate, 6) AS success_rate, success_rate_score FROM rates""",
    "stability": f"""WITH {A}, {A_BASE}, {STABLE} SELECT workspace_id, job_id, stability_score,
  round(cv, 6) AS coefficient_of_variation FROM stable""",
    "job_health": f"WITH {HEALTH} SELECT {HEALTH_COLUMNS} FROM health",
    "job_health_trend": f"""WITH {J}, {A}, {A_BASE}, {RATES}, {STABLE}, {TREND},
{health(TREND_SCORE, "LEFT JOIN trend USING (workspace_id, job_id)")}
SELECT workspace_id, job_id, round(score, 6) AS health_score, health_category FROM health""",
    "job_utilisation": f"""WITH {A}, {N}, {UTILISED}
SELECT workspace_id, job_id, round(coalesce(covered, 0), 6) AS covered_seconds, round(busy, 4) AS busy_percent,
  CASE WHEN busy IS NOT NULL THEN round(greatest(0, least(1, busy / 60)), 6) END AS score
FROM with_slices LEFT JOIN utilised USING (workspace_id, job_id)""",
    "job_health_components": f"""WITH {J}, {A}, {N}, {A_BASE}, {RATES}, {STABLE}, {TREND}, {UTILISED},
{health(TREND_SCORE, "LEFT JOIN trend USING (workspace_id, job_id) LEFT JOIN utilised USING (workspace_id, job_id)",
        "CASE WHEN busy IS NULL THEN CAST(0.7 AS DOUBLE) ELSE greatest(0, least(1, busy / 60)) END")}
SELECT workspace_id, job_id, round(score, 6) AS health_score, health_category FROM health""",
    "recent_stats": f"""WITH {A} SELECT workspace_id, job_id,
  round(recent_avg_duration, 3) AS recent_avg_duration, recent_run_count FROM ({RECENT_A})""",
    "anomalies_t2": f"""WITH {A}, {A_BASE}, {found(RECENT_A, 2.0)}
SELECT {anomaly_columns(AS_OF)} FROM found""",
    "anomalies_t1": f"""WITH {A}, {A_BASE}, {found(RECENT_A, 1.0)}
SELECT {anomaly_columns(AS_OF)} FROM found""",
    "anomalies_run_grain": f"""WITH {B}, {baselines("b", B_WINDOW)}, {found(RECENT_B, 1.0)}
SELECT {anomaly_columns("TIMESTAMP '2001-08-02 00:00:00'")} FROM found""",
    "failure_alerts": f"""WITH {J}, {A}, {FAILED}, {top_failed("LIMIT 10")}
SELECT {ALERT_LIST}, error_message, rule_threshold FROM failures""",
    "failure_alerts_all": f"""WITH {J}, {A}, {FAILED}
SELECT {ALERT_LIST}, error_message, rule_threshold FROM all_failures""",
    "failures_named_at_start": f"""WITH {J}, {B},
failed AS (
  SELECT DISTINCT workspace_id, job_id, run_id, period_start_time FROM b
  WHERE result_state = 'FAILED' AND period_start_time <= {MIDWAY} AND period_start_time >= {MIDWAY} - INTERVAL '365 days'
),
named AS (
  SELECT failed.*, j.job_name AS name, row_number() OVER (PARTITION BY failed.workspace_id, failed.job_id, run_id, period_start_time
           ORDER BY change_time DESC NULLS LAST, change_id DESC) AS nth
  FROM failed LEFT JOIN j ON failed.workspace_id = j.workspace_id AND failed.job_id = j.job_id
       AND change_time + INTERVAL '45 days' <= period_start_time
)
SELECT 'job_failure_' || workspace_id || '_' || job_id || '_' || run_id || '_' || (epoch_us(period_start_time) // 1000)
         || '_' || CAST(floor(epoch(period_start_time)) AS BIGINT) AS id,
  workspace_id, job_id, coalesce(name, 'Job ' || job_id) AS job_name,
  'Job Failure: ' || coalesce(name, 'Job ' || job_id) AS title, period_start_time AS created_at
FROM named WHERE nth = 1""",
    "alerts_across_collections": f"""WITH {A},
f AS (
  SELECT *, 'job_failure_' || workspace_id || '_' || job_id || '_' || run_id || '_'
           || (epoch_us(period_start_time) // 1000) AS id
  FROM a WHERE result_state = 'FAILED'
),
none AS (SELECT workspace_id, job_id, period_start_time AS created_at FROM f WHERE false), {collections(COLLECTIONS, 720, 25, 40)}
SELECT * FROM history""",
    "alert_colours": f"""WITH {HEALTH}, {FAILED}, {top_failed()}, {low()}, {found(RECENT_A, 1.0)},
shown AS (
  SELECT id, 'job_failure' AS alert_type, '#8b0000' AS colour, title, workspace_id, job_id FROM failures
  UNION ALL SELECT id, 'health_score_low', '#36a64f', title, workspace_id, job_id FROM lows
  UNION ALL
  SELECT 'anomaly_' || workspace_id || '_' || job_id || '_1706659200', 'performance_anomaly', '#ff9500',
         'Performance Anomaly: ' || coalesce(nullif(job_name, ''), 'Job ' || job_id), workspace_id, job_id
  FROM found LEFT JOIN (SELECT workspace_id, job_id, job_name FROM jobs) USING (workspace_id, job_id)
  WHERE anomaly_score > 2.0
),
digests AS (
  SELECT alert_type, count(*) || ' alerts' AS title, 'Jobs: ' || count(DISTINCT (workspace_id, job_id)) AS message
  FROM shown GROUP BY 1
)
SELECT id, colour, NULL AS chat_payload, '[Job alert] ' || title AS email_subject FROM shown
UNION ALL
SELECT 'digest_' || alert_type, '#ff0000',
  CAST(json_object('text', title, 'channel', '#alerts', 'username', 'alerts',
    'icon_emoji', ':warning:', 'blocks', json_array(
      json_object('type', 'header', 'text',
                  json_object('type', 'plain_text', 'text', chr(128680) || ' ' || title)),
      json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', message))),
    'attachments', json_array(json_object('color', '#ff0000', 'fields', json_array()))) AS VARCHAR),
  '[Job alert] ' || title
FROM digests""",
    "health_alerts": f"""WITH {HEALTH}, {low("LIMIT 5")}
SELECT {ALERT_LIST}, health_score, threshold FROM lows""",
    "health_alerts_all": f"""WITH {HEALTH}, {low()}
SELECT {ALERT_LIST}, health_score, threshold FROM lows""",
    "anomaly_alerts": f"""WITH {J}, {A}, {A_BASE}, {found(RECENT_A, 1.0)}
SELECT 'anomaly_' || workspace_id || '_' || job_id || '_1706659200' AS id, 'performance_anomaly' AS alert_type,
  'medium' AS severity, 'Performance Anomaly: ' || shown AS title,
  'Job ''' || shown || ''' runs ' || anomaly_type || ' with an anomaly score of '
    || printf('%.1f', anomaly_score) AS message,
  job_id, shown AS job_name, workspace_id, {AS_OF} AS created_at, anomaly_type,
  '1.0' AS threshold
FROM (SELECT found.*, coalesce(nullif(job_name, ''), 'Job ' || found.job_id) AS shown
      FROM found LEFT JOIN jobs USING (workspace_id, job_id))""",
    "alerts_routed": f"""WITH {ALERTS}
SELECT id, alert_type, severity, title, channel, channel IN ('slack', 'webhook') AS deliverable
FROM (SELECT *, unnest(CASE WHEN alert_type = 'job_failure' THEN ['slack', 'email']
                            ELSE ['slack'] END) AS channel FROM alerts)""",
    "alert_payloads": f"""WITH {ALERTS},
lined AS (
  SELECT *, CASE severity WHEN 'high' THEN '#ff0000' ELSE '#ff9500' END AS colour,
         strftime(created_at, '%Y-%m-%d %H:%M:%S UTC') AS stamp FROM alerts
)
SELECT id, alert_type, colour,
  CAST(json_object('text', title, 'channel', '#alerts', 'username', 'alerts',
    'icon_emoji', ':warning:', 'blocks', json_array(
      json_object('type', 'header', 'text',
                  json_object('type', 'plain_text', 'text', chr(128680) || ' ' || title)),
      json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', message)),
      json_object('type', 'section', 'fields', json_array(
        json_object('type', 'mrkdwn', 'text', '*Job:* ' || job_name),
        json_object('type', 'mrkdwn', 'text', '*Severity:* ' || upper(severity)),
        json_object('type', 'mrkdwn', 'text', '*Time:* ' || stamp)))),
    'attachments', json_array(json_object('color', colour, 'fields', json_array()))) AS VARCHAR)
    AS chat_payload,
  '[Job alert] ' || title AS email_subject,
  'Job alert' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Severity: '
    || upper(severity) || chr(10) || 'Message: ' || message || chr(10) || 'Job: ' || job_name
    || chr(10) || 'Time: ' || stamp || chr(10) || chr(10) || 'Additional Details:' || chr(10)
    || details AS email_body
FROM lined""",
    "alert_history": f"""WITH {ALERTS} SELECT {ALERT_LIST}, 'slack' AS channels_sent FROM alerts""",
    "alert_counts": f"""WITH {ALERTS} SELECT alert_type, count(*) AS alert_count FROM alerts
GROUP BY 1""",
    "alerts_rate_limited": f"""WITH RECURSIVE {A},
f AS (SELECT *, period_start_time AS created_at, date_trunc('second', period_start_time) AS t,
  row_number() OVER (PARTITION BY workspace_id, job_id, date_trunc('second', period_start_time)
                     ORDER BY period_start_time, run_id) AS nth
  FROM a WHERE result_state = 'FAILED'),
d AS (SELECT DISTINCT workspace_id, job_id, t FROM f),
nxt AS (
  SELECT x.workspace_id, x.job_id, x.t, min(y.t) AS later
  FROM d x LEFT JOIN d y ON x.workspace_id = y.workspace_id AND x.job_id = y.job_id
       AND y.t >= x.t + INTERVAL '720 minutes'
  GROUP BY 1, 2, 3
),
sent AS (
  SELECT workspace_id, job_id, min(t) AS t FROM d GROUP BY 1, 2
  UNION ALL
  SELECT nxt.workspace_id, nxt.job_id, nxt.later
  FROM sent JOIN nxt ON sent.workspace_id = nxt.workspace_id AND sent.job_id = nxt.job_id
       AND sent.t = nxt.t
  WHERE nxt.later IS NOT NULL
),
quiet AS (
  SELECT f.*, f.nth = 1 AND sent.t IS NOT NULL AS passes
  FROM f LEFT JOIN sent ON f.workspace_id = sent.workspace_id AND f.job_id = sent.job_id AND f.t = sent.t
),
hourly AS (
  SELECT *, passes AND row_number() OVER (
      PARTITION BY passes, date_trunc('hour', created_at)
      ORDER BY created_at, workspace_id, job_id, run_id) <= 2 AS in_hour FROM quiet
),
daily AS (
  SELECT *, in_hour AND row_number() OVER (
      PARTITION BY in_hour, date_trunc('day', created_at)
      ORDER BY created_at, workspace_id, job_id, run_id) <= 20 AS in_day FROM hourly
)
SELECT workspace_id, job_id, run_id, created_at,
  CASE WHEN NOT passes THEN 'cooldown' WHEN NOT in_hour THEN 'hour' WHEN NOT in_day THEN 'day' END
    AS suppressed_by
FROM daily""",
    "collection_counts": f"""WITH {COUNTED} SELECT name, row_count FROM counted""",
    "collection_run_log": f"""WITH {COUNTED}
SELECT 'completed' AS status, 'development' AS environment, 30 AS collection_window_days,
  (SELECT '{{' || string_agg('"' || name || '": ' || row_count, ', ' ORDER BY place) || '}}'
   FROM counted WHERE place <= 8) AS records_processed,
  '{{"job_failure": ' || (SELECT row_count FROM counted WHERE name = 'job_failure')
  || ', "health_score_low": ' || (SELECT row_count FROM counted WHERE name = 'health_score_low')
  || ', "performance_anomaly": 0, "cost_spike": 0}}' AS alerts_sent, '[]' AS errors""",
    "source_counts": """SELECT 'job_changes' AS source, count(*) AS row_count FROM orders
UNION ALL SELECT 'run_slices', count(*) FROM events
UNION ALL SELECT 'node_samples', count(*) FROM events
UNION ALL SELECT 'usage', count(*) FROM orders""",
    "source_probe": """SELECT 'job_changes' AS source, count(*) >= 0 AS accessible FROM orders
UNION ALL SELECT 'run_slices', count(*) >= 0 FROM events
UNION ALL SELECT 'node_samples', count(*) >= 0 FROM events
UNION ALL SELECT 'usage', count(*) >= 0 FROM orders
UNION ALL SELECT 'missing', false""",
    "top_unhealthy": f"""WITH {HEALTH} SELECT job_name, owned_by, round(score, 6) AS health_score,
  health_category, requires_attention FROM health WHERE requires_attention
ORDER BY score, workspace_id, job_id LIMIT 20""",
    "recent_pipeline_runs": f"""WITH {A},
log AS (
  SELECT CAST(period_start_time AS DATE) AS day, min(period_start_time) AS start_time,
         max(period_end_time) AS end_time, count(*) AS runs,
         count(*) FILTER (WHERE result_state = 'FAILED') AS failed
  FROM a WHERE {A_WINDOW} GROUP BY 1
)
SELECT 'run-' || day AS run_id, CASE WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status,
  start_time, CAST(floor((epoch_ms(end_time) - epoch_ms(start_time)) / 1000) AS BIGINT)
    AS duration_seconds,
  '{{"runs":' || runs || '}}' AS records_processed,
  '{{"job_failure":' || failed || '}}' AS alerts_sent
FROM log ORDER BY start_time DESC LIMIT 10""",
    "write_read_roundtrip": f"""WITH {A} SELECT {RUN_COLUMNS}, {AS_OF} AS collected_at,
  CASE WHEN result_state = 'SUCCESS' THEN NULL ELSE true END AS needs_review FROM a
WHERE {A_WINDOW}""",
    "metrics_5min": f"WITH {N} {FIVE_MINUTES}",
    "cost_daily": f"WITH {C} SELECT {COST_COLUMNS} FROM costs",
    "cost_spikes": f"WITH {C} SELECT {COST_COLUMNS} FROM costs WHERE cost_ratio > 1.5",
    "cost_alerts": f"""WITH {J}, {C}
SELECT 'cost_spike_' || workspace_id || '_' || job_id || '_' || usage_date || '_' || CAST(epoch(usage_date) AS BIGINT) AS id,
  'cost_spike' AS alert_type, 'high' AS severity, 'Cost Spike: ' || shown AS title,
  job_id, shown AS job_name, workspace_id, CAST(usage_date AS TIMESTAMP) AS created_at,
  CAST(usage_date AS VARCHAR) AS usage_date, '1.5' AS threshold
FROM (SELECT costs.*, coalesce(nullif(job_name, ''), 'Job ' || costs.job_id) AS shown
      FROM costs LEFT JOIN jobs USING (workspace_id, job_id) WHERE cost_ratio > 1.5)""",
    "costs_incremental": f"""WITH {C.replace("FROM orders", "FROM orders WHERE o_orderdate < TIMESTAMP '1999-02-01'")}
SELECT {COST_COLUMNS}, strftime(usage_date, '%Y-%m') AS usage_month FROM costs""",
    "run_costs": f"""WITH {B}, {RUN_COSTS}
SELECT *, round(cost_units / 1000000, 6) AS cost FROM shares""",
    "cost_efficiency": f"""WITH {B}, {RUN_COSTS}
SELECT workspace_id, job_id,
  round(CASE WHEN sum(cost_units) > 0 THEN coalesce(sum(cost_units) FILTER (succeeded), 0) / sum(cost_units) END, 6) AS score
FROM shares WHERE run_id IS NOT NULL GROUP BY 1, 2""",
    "runs_upsert": f"""WITH {A} SELECT {RUN_COLUMNS}, CAST(period_start_time AS DATE) AS run_date
FROM a""",
    "metrics_stream": f"""WITH {N}, w AS ({FIVE_MINUTES}) SELECT * FROM w""",
    "runs_stream_dedup": f"""WITH {A} SELECT {RUN_COLUMNS}, {AS_OF} AS collected_at,
  CAST(period_start_time AS DATE) AS run_date FROM a""",
    "failure_alerts_stream": f"""WITH {A},
named AS (
  SELECT f.*, 'job ' || c.event_id AS name,
         row_number() OVER (PARTITION BY f.run_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) AS nth
  FROM (SELECT * FROM a WHERE result_state = 'FAILED') AS f
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') AS c
    ON f.job_id = 'job-' || c.user_id AND c.ts <= f.period_start_time AND c.ts >= f.period_start_time - INTERVAL '40 days'
)
SELECT 'job_failure_' || workspace_id || '_' || job_id || '_' || run_id || '_' || (epoch_us(period_start_time) // 1000)
         || '_' || CAST(floor(epoch(period_start_time)) AS BIGINT) AS id,
  workspace_id, job_id, coalesce(name, 'Job ' || job_id) AS job_name,
  'Job ''' || coalesce(name, 'Job ' || job_id) || ''' has failed with error: '
    || coalesce(nullif(state_message, ''), 'Unknown error') AS message,
  period_start_time AS created_at, CAST(period_start_time AS DATE) AS alert_date
FROM named WHERE nth = 1""",
    "alert_cooldown_stream": f"""WITH RECURSIVE {A},
f AS (
  SELECT DISTINCT workspace_id, job_id, date_trunc('second', period_start_time) AS t
  FROM a WHERE result_state = 'FAILED'
),
nxt AS (
  SELECT x.workspace_id, x.job_id, x.t, min(y.t) AS later
  FROM f x LEFT JOIN f y ON x.workspace_id = y.workspace_id AND x.job_id = y.job_id
       AND y.t >= x.t + INTERVAL '720 minutes'
  GROUP BY 1, 2, 3
),
sent AS (
  SELECT workspace_id, job_id, min(t) AS t FROM f GROUP BY 1, 2
  UNION ALL
  SELECT nxt.workspace_id, nxt.job_id, nxt.later
  FROM sent JOIN nxt ON sent.workspace_id = nxt.workspace_id AND sent.job_id = nxt.job_id
       AND sent.t = nxt.t
  WHERE nxt.later IS NOT NULL
)
SELECT 'job_failure' AS alert_type, workspace_id, job_id, t AS sent_at FROM sent""",
}

ORACLE["stream_batch_counts"] = f"""SELECT 'alerts_sent' AS name, count(*) AS rows_logged, count(*) AS rows_stored
FROM ({ORACLE['alert_cooldown_stream']}) AS sent"""

#: Late states end up where those that come in time do.
ORACLE["runs_late_repaired"] = ORACLE["runs_upsert"]
