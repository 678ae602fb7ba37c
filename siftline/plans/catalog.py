"""All registered queries."""

from . import (  # noqa: F401  (importing registers the queries)
    file_queries, line_queries, model_queries, rule_queries, source_queries, stream_queries, workflow_queries,
)
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
