"""Spark-native text retrieval, evaluation and dataset engineering."""
