"""Geospatial feature processing expressed as Spark DataFrames."""
