"""Queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import catalog_queries, dedup_queries, evidence_queries, fact_queries, retrieval_queries, stream_queries, text_queries

_MODULES = [catalog_queries, dedup_queries, evidence_queries, fact_queries, retrieval_queries, stream_queries, text_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return dedup_queries.flagship(spark, sf_dir)
