"""A PySpark-native analytics engine for long, densely sampled signals."""
