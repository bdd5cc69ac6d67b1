"""Spark-native analytics for cold-cloud systems in infrared image series."""
