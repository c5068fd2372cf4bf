"""A Spark-native retail integration and leakage-safe feature engine."""
