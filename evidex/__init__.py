"""evidex: a PySpark-native engine for deterministic, lexical evidence retrieval."""

__version__ = "0.1.0"
