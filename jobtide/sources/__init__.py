"""Reading the telemetry tables, probing them, and fixtures over the test tables."""
