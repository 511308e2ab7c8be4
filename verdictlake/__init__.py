"""Spark-native analytics over verified attempts."""
