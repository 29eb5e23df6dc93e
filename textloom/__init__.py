"""textloom: Spark-native text analytics and semantic sentence search."""

__version__ = "0.1.0"
