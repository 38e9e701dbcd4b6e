"""All queries of the library, with the SQL that checks them."""

from __future__ import annotations

from . import dedup_queries, hierarchy_queries, listing_queries, retrieval_queries, source_queries, text_queries

_MODULES = [retrieval_queries, listing_queries, dedup_queries, text_queries, source_queries, hierarchy_queries]


def queries() -> dict:
    """Every query by name: (spark, folder of the tables) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """The SQL of each query that SQL can express."""
    return {name: s for m in _MODULES for name, s in m.SQL.items()}


def flagship(spark, sf_dir):
    """Hybrid search: keyword and semantic rankings fused, with titles."""
    return retrieval_queries.hybrid_search(spark, sf_dir)
