"""Spark-native analytics over security telemetry: every operator is a function from DataFrames to a DataFrame."""
