"""Spark-native formula and text retrieval engine."""
