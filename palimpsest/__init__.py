"""Spark-native engine for building and analysing controlled evaluation data."""
