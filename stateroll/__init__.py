"""Aggregate-first business metrics on PySpark: mergeable states, metrics and reports over DataFrames."""
