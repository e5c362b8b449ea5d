"""Spark-native drift analytics: detection, localisation, scoring and profiling of long panels."""
