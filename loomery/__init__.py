"""loomery: a PySpark-native engine for preparing, auditing and comparing text corpora."""
