"""Spark jobs that turn geo-located point data into datasets for studying how events spread."""
