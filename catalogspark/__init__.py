"""A PySpark-native engine for versioned catalog data."""
