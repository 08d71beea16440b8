"""Job observability on Spark: metadata, runs, metrics, baselines, health, anomalies, alerts."""
