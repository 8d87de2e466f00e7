"""Registered queries of the library."""

from . import catalog_queries, search_queries, streaming_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
