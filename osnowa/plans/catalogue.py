"""All catalogue queries and their SQL counterparts."""

from __future__ import annotations

from . import answer_queries, dedup_queries, layer_queries, more_queries, record_queries, report_queries, retrieval_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "answer_queries", "dedup_queries", "layer_queries", "more_queries", "record_queries", "report_queries", "retrieval_queries", "text_queries"]
