"""Registered queries (name -> callable) and their DuckDB twins (name -> SQL)."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep
