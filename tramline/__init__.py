"""Spark-native analytics over public-transit networks."""
