"""Streaming of the call analytics engine."""
