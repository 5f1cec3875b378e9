"""Spark-native building and analysis of answer/rationale training data."""
