"""Spark-native reconstruction and audit of documents at scale."""
