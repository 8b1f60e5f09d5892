"""codeloom: a PySpark-native analytics engine for code-intelligence tables."""
