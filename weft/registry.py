"""Where queries and their SQL counterparts are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; a query may have an SQL text that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is declared twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep

    def capabilities(self) -> list[dict]:
        """{name, about, area, stated}: what can be asked, from the queries themselves; ``stated`` where SQL gives the same rows."""
        return [
            {"name": n, "about": (q.__doc__ or "").strip().split("\n")[0], "area": q.__module__.rsplit(".", 1)[-1], "stated": n in self.sql}
            for n, q in sorted(self.queries.items())
        ]
