"""Spark-native analytics for correspondence."""
