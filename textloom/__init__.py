"""textloom: a Spark-native engine for reconciling and searching text corpora."""

__version__ = "0.1.0"
