"""Spark-native topological data analysis."""
