"""Driving-telemetry analytics on Spark DataFrames."""
