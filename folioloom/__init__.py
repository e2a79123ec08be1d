"""folioloom: a PySpark-native document-intelligence and retrieval engine."""
