"""Writing result tables, upserts and the run log."""
