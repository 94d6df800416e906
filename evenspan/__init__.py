"""evenspan: a PySpark-native engine for studying positional and language bias in long-document embeddings."""
