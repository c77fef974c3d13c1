"""Spark-first market time-series analytics: DataFrame in, DataFrame out."""
