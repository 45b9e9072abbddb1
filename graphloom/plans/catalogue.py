"""All queries of the core and their SQL equivalents."""

from __future__ import annotations

from graphloom.plans import graph_queries, pipeline_queries, retrieval_queries, session_queries

PARTS = (pipeline_queries, retrieval_queries, graph_queries, session_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "bm25_search_diverse"
