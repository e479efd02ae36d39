"""A Spark-native engine that turns collections of documents into retrieval-ready chunks."""
