"""Spark-native investigation analytics: pure DataFrame operators over evidence, entities and graphs."""
