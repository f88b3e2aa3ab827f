"""A Spark-native engine for keyed event streams and tables."""
