"""Every named query of the library with the SQL that it is checked against."""

from __future__ import annotations

from driftlex.plans import corpus_queries, reply_queries, source_queries  # noqa: F401  registers
from driftlex.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
