"""Spark-native analytics for logs of paired contests."""
