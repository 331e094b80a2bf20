"""Marketplace analytics on Spark: DataFrame operators, column functions, sources and streaming jobs."""
