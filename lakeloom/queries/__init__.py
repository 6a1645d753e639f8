"""Queries of the warehouse operators over the shared tables, each with the SQL of its result."""

from lakeloom.queries.registry import ORACLE_SQL, QUERIES
from lakeloom.queries import cdc, landing, quality, star  # noqa: F401  (they register themselves)

__all__ = ["ORACLE_SQL", "QUERIES"]
