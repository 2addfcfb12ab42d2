"""leafmill: a PySpark-native engine for querying large collections of PDF files."""

__version__ = "0.1.0"
