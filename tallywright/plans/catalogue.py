"""All registered queries."""

from . import evaluation, model_queries, scoring_queries, search_queries, source_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
