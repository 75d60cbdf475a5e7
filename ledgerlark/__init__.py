"""A PySpark-native analytics engine for semi-structured registry data."""
