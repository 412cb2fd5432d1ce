"""Spark-native engine for labelled signal epochs and dataset governance."""
