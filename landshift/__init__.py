"""Raster change analytics as Spark DataFrame jobs."""
