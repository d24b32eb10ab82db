"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from weft.llm import queries

QUERIES = queries.QUERIES
SQL = queries.SQL
