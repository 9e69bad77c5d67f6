"""A PySpark-native analytics library for research-evidence tables."""
