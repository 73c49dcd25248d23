"""Importing this module registers every query."""

from linkgraph.plans import graph_queries, matching_queries, path_queries, search_queries, table_queries, text_queries  # noqa: F401
from linkgraph.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
