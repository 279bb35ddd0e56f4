"""How a module of queries keeps its queries and their SQL."""

from __future__ import annotations

from .fixtures import with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = with_views(sql)
            return f

        return keep
