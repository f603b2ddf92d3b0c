"""basewise: a PySpark-native engine for per-base sequencing profiles."""
