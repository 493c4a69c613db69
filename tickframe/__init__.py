"""Replay-telemetry analytics on Spark DataFrames."""
