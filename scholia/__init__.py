"""Spark-native analytics for corpora of academic documents."""
