"""Spark-native engine for governed text records and hybrid search."""
