"""Spark-native text-safety analytics: detection, scoring, routing, compression and audit of text and JSON records."""
