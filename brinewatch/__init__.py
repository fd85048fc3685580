"""Spark-native security event analytics."""
