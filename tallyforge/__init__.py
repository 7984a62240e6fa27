"""Spark-native scans, aggregation and deduplication with exact, checked semantics."""
