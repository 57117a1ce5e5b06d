"""Every query of the library by name, with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from lattica.sources.projection import SQL, Store

#: Modules of this package that hold queries.
MODULES = ["relational", "textual", "retrieval", "fulltext", "graphs", "curation", "exchange", "further"]


class Book:
    """Queries over a store, each as a function of it and, where SQL can express it, as a SELECT over the projection's expressions."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Callable, select: str | None = None, ctes: str = "", recursive: bool = False) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = lambda spark, sf_dir: fn(Store(spark, sf_dir))
        if select is not None:
            self.sql[name] = f"WITH {'RECURSIVE ' * recursive}{SQL.strip()}{',' * bool(ctes)}\n{ctes}\n{select}"


def _books() -> list[Book]:
    return [importlib.import_module(f"lattica.plans.{m}").BOOK for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for b in _books() for k, v in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for b in _books() for k, v in b.sql.items()}
