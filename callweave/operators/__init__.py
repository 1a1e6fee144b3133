"""Operators of the call analytics engine."""
