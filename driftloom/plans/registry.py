"""How a module of queries names them."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    """Queries and SQL by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add
