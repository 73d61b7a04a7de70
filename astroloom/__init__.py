"""A Spark-native sky-catalog query engine."""

__version__ = "0.1.0"
