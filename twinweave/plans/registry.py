"""All registered queries and their oracle SQL."""

from __future__ import annotations

from twinweave.plans import files  # noqa: F401  registers its queries
from twinweave.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
