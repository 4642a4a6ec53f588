"""Spark-first engine for time-stamped evidence, forecasts and their evaluation."""
