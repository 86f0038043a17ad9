"""Named queries over the driver's tables, and their twins in SQL."""

from newsdesk.plans import archive_queries  # noqa: F401  registers its queries
from newsdesk.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
