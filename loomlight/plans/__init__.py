"""The queries: each module pairs Spark queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlight.plans import graph_queries, judged_queries, more_queries, relational_queries, retrieval_queries, stream_queries, text_queries, vector_queries

MODULES = (vector_queries, retrieval_queries, graph_queries, relational_queries, text_queries, stream_queries, more_queries, judged_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
