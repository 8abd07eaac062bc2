"""Spark-native analytics over records extracted from documents."""
