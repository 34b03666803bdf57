"""Spark-native analytics over key-value mutation logs."""

__version__ = "0.1.0"
