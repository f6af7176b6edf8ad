"""Spark-native analytics over particle and halo catalogues."""
