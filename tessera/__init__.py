"""Tessera: a Spark-native document retrieval and corpus preparation engine."""
