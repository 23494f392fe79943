"""A PySpark-native analytics engine for document libraries."""
