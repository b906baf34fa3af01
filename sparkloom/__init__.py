"""Spark-native document search, near-duplicate analytics and corpus preparation."""
