"""Paired-fact construction, vector aggregation and evaluation as Spark DataFrame jobs."""
