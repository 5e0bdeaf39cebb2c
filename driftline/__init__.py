"""Keyed, timestamped event analytics on Spark: one API for batch tables and Structured Streaming."""
