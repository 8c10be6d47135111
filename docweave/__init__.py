"""docweave: a PySpark-native engine for document structure and corpus preparation."""

__version__ = "0.1.0"
