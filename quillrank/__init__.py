"""Spark-native retrieval, ranking and evaluation engine for news logs."""
