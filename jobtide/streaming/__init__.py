"""Structured Streaming forms of metrics, run feed and alert cooldown."""
