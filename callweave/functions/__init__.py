"""Functions of the call analytics engine."""
