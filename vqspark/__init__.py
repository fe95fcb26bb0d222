"""Spark-native vector compression, search and evaluation analytics."""
