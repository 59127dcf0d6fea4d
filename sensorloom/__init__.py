"""Spark jobs for wearable-sensor feature tables, labels, evaluation and alerts."""
