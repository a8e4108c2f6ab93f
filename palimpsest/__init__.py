"""Spark-native text-safety analytics: detection, resolution, actions and decisions over text segments."""
