"""A PySpark-native retrieval and analytics engine for text and source-code corpora."""

__version__ = "0.1.0"
