"""corpusloom: a Spark-native engine for disclosure-text analytics."""

__version__ = "0.1.0"
