"""Spark-native analytics over document collections: sources, facts, evidence graph, ledgers and retrieval."""
