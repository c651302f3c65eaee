"""Every query of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import change_queries, entity_queries, more_queries, record_queries, retrieval_queries, rule_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "ret_rrf"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
