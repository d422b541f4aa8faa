"""Spark-native analytics over annotated intervals and sequences."""
