"""Spark-first engine for point observations, tabular analytics and state streams."""
