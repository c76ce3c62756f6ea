"""Spark-native analytics over gridded terrain, keyed by map_id."""
