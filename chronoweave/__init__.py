"""Temporal event-graph analytics as Spark DataFrames."""
