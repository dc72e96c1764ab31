"""The queries over the engine's own operators, each with its SQL."""

from __future__ import annotations

from . import model_queries, pool_queries, selection_queries, sequence_queries, sql_queries, table_queries

FLAGSHIP = "select_quota_roundrobin"
MODULES = [sequence_queries, table_queries, selection_queries, pool_queries, model_queries, sql_queries]


def queries() -> dict:
    """Name to query."""
    return {name: make for m in MODULES for name, (make, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where there is one."""
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
