"""Spark-native engine for offline evaluation of passage retrieval."""
