"""Spark-native analytics for ordered flight telemetry."""
