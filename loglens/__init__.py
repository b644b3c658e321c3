"""Spark-native analytics for system logs."""
