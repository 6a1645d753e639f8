"""sources of the warehouse engine."""
