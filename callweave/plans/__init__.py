"""Plans of the call analytics engine."""
