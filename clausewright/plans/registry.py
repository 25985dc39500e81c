"""Names of the queries, the functions that make them, and their SQL."""

from __future__ import annotations

from clausewright.plans.queries import QUERIES
from clausewright.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
