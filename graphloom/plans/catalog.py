"""Registry of the core queries: name -> (spark, directory) -> DataFrame, and the SQL that checks them."""

from __future__ import annotations

from graphloom.plans import graph_queries, ingest_queries, lifecycle_queries, problem_queries, text_queries, traversal_queries, workflow_queries

MODULES = [problem_queries, graph_queries, traversal_queries, text_queries, lifecycle_queries, ingest_queries, workflow_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
