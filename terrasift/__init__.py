"""Geospatial data preparation and evaluation as Spark DataFrame jobs."""
