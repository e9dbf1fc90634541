"""lodestack: a PySpark-native memory and retrieval analytics engine."""
