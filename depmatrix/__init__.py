"""Spark-native analysis of dependency structure matrices."""
