"""Descriptive analytics, data quality, longitudinal and linkage operators on Spark DataFrames."""

__version__ = "0.1.0"
