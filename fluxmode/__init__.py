"""Spark-native signal, mode and event analysis."""
