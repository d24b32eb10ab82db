"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """The queries of one module by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Registers a query; ``sql`` gives the same in DuckDB's SQL."""

        def wrap(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap
