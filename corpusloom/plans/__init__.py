"""All registered queries over the given tables."""

from . import analytics_queries, chunk_queries, context_queries, evaluation_queries, retrieval_queries, source_queries, streaming_queries, text_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics_queries", "chunk_queries", "context_queries", "evaluation_queries", "retrieval_queries", "source_queries", "streaming_queries", "text_queries"]
