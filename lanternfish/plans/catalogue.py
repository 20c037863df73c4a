"""Named queries over the test tables and their DuckDB counterparts, gathered from the modules beside this one."""

from __future__ import annotations

from lanternfish.plans import catalog_queries, conversation_queries, text_queries, vector_queries
from lanternfish.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "conversation_queries", "text_queries", "vector_queries"]
