"""Spark-native analytics over versioned, evidence-backed graphs, text and space."""
