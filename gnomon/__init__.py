"""gnomon: a PySpark-native engine for time-indexed text."""
