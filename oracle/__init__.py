"""Equivalent SQL for the reports, run by DuckDB on the same test tables."""

from oracle.statements import oracle_sql

__all__ = ["oracle_sql"]
