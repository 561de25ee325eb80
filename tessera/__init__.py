"""A PySpark-native engine for document retrieval and the analytics around it."""
