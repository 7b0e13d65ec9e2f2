"""Spark-native analytics for news and social streams."""
