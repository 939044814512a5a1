"""A Spark-native library for document, evidence and training-data analytics."""
