"""Spark-native analytics for labelled, batched, high-dimensional tables."""
