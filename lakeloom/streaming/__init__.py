"""streaming of the warehouse engine."""
