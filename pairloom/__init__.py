"""Spark-native resolution and evaluation of matched record pairs."""
