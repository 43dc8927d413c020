"""Spark-native analytics over labelled token sequences."""
