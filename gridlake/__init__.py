"""Spark-native analytics for gridded earth-observation data and its sample tables."""
