"""Spark-native engine for evidence networks, transaction flows and corpus jobs."""
