"""Spark-native alignment and repair of overlapping damaged recordings."""
