"""Geospatial point aggregation on Spark."""
