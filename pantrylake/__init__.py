"""Spark-native catalogue analytics engine."""
