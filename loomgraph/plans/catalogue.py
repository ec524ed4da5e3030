"""All registered queries of the graph engine and their oracle SQL."""

from __future__ import annotations

from . import audit_queries, code_queries, compile_queries, document_queries, fact_queries, knowledge_queries, scan_queries, scope_queries, small_queries, store_queries, update_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
