"""All queries of the library."""

from quarry.plans import code, detail, graphs, more, relational, streams, textual  # noqa: F401  each registers its queries
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
