"""Every query by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from vellum.plans import table_queries, table_sql, text_queries, text_sql

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES}
ORACLES = {**text_sql.ORACLES, **table_sql.ORACLES}
