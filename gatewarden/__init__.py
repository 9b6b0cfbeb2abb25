"""Spark-first content-safety analytics: policies, detectors, redaction and decisions over DataFrames."""
