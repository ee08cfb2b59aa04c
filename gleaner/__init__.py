"""Spark-native corpus analytics and hybrid retrieval."""
