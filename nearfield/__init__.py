"""Spark-native vector search: exact and approximate nearest neighbours over DataFrames."""
