"""Spark-native analytics over time-aligned performance notes."""
