"""Spark-native retrieval, maintenance and analysis of documents."""
