"""Spark-native analytics for listed index options."""
