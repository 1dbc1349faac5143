"""Interval time-series analytics on Spark.

Irregular readings become intervals that hold a value over ``[start, end)``; every operator is a
function from DataFrames to DataFrames over a fleet of series keyed by ``(site_id, series_id)``.
"""

KEYS = ("site_id", "series_id")
