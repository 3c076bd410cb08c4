"""Spark-native analytics over event-sourced, content-addressed catalogs."""
