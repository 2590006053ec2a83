"""Anomaly detection on numeric tables as Spark jobs."""
