"""Spark-native analytics for recorded voice-agent calls."""

__version__ = "0.1.0"
