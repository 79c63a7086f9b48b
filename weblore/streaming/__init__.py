"""Spark-native extras: the reference pipeline has no streams."""
