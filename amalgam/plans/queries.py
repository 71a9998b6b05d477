"""All registered queries and oracles of record linkage."""

from __future__ import annotations

from . import entity_queries, pair_queries, standard_queries, stored_queries  # noqa: F401  (they register)
from .registry import ORACLE, QUERIES

ORACLE |= {"recovery_by_corruption": stored_queries.RECOVERY_SQL, "recovery_by_damaged_fields": stored_queries.RECOVERY_COUNT_SQL}

__all__ = ["ORACLE", "QUERIES"]
