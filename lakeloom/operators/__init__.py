"""operators of the warehouse engine."""
