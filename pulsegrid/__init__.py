"""A PySpark-native analytics engine for type-tagged time-series archives."""
