"""Spark-native analytics for airspace and maritime launch notices."""
