"""plans of the warehouse engine."""
