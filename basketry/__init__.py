"""Spark-native grocery matching, offer comparison and basket planning."""
