"""Spark-native analytics over acoustic recordings, events, clips and encounters."""
