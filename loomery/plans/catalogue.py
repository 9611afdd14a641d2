"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from loomery.plans import contract_queries, decision_queries, file_queries, flow_queries, near_queries, order_queries, parsing_queries, review_queries, stream_queries, table_queries, text_queries

PARTS = (text_queries, order_queries, table_queries, contract_queries, near_queries, stream_queries, decision_queries, review_queries, parsing_queries, flow_queries, file_queries)


def queries() -> dict:
    """All queries of the library's own operators, by name."""
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL expresses, by name."""
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
