"""tarnline: a PySpark-native analytics library."""
