"""All named queries."""

from __future__ import annotations

from eventloom.plans import log_queries, request_queries, score_queries, sequence_queries  # noqa: F401
from eventloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
