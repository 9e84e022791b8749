"""Spark-native analytics engine for urban flooding."""
