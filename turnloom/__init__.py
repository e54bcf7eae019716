"""turnloom: a PySpark-native engine for retrieval-augmented dialogue-state analytics."""
