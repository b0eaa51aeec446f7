"""Spark-native processing of bibliographic records, documents and training text."""
