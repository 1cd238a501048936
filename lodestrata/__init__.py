"""Lodestrata: a Spark-native analytics and retrieval library."""
