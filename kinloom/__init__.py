"""kinloom: a PySpark-native engine for record linkage, scoring and matching."""
