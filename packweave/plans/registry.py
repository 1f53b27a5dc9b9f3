"""All queries of the engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import analysis_queries, corpus_queries, evaluation_queries, io_queries, packing_queries, retrieval_queries

PARTS = (corpus_queries, packing_queries, retrieval_queries, analysis_queries, evaluation_queries, io_queries)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.SQL.items()}
