"""The registered queries and their SQL."""

from . import analytics_queries, citation_queries, feedback_queries, matching_queries, quality_queries, record_queries, text_queries, training_queries, upkeep_queries  # noqa: F401  each registers its queries
from .registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
