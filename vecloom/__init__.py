"""vecloom: a PySpark-native engine for numerical analytics over large tables of vectors."""

__version__ = "0.1.0"
