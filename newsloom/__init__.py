"""newsloom: a Spark-native content-analytics engine."""

__version__ = "0.1.0"
