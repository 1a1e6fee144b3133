"""Sources of the call analytics engine."""
