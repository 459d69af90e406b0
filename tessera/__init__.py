"""A PySpark-native array-analytics engine."""
