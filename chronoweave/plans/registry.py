"""Where query modules register themselves."""

from __future__ import annotations

from collections.abc import Callable

from .views import duck

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL over the named domain tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = duck(sql, *views)
        return f

    return add
