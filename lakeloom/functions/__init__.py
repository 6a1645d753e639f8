"""functions of the warehouse engine."""
