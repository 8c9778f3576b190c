"""All queries of the library's own operators."""

from .plans import aggregates, filters, geometry, joins, metrics, shapes, sinks, streams, windows  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
