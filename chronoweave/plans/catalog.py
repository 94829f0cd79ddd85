"""Registry of the engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from .registry import ORACLE, QUERIES

from . import evidence, governed, networks, streams, transactions, uploads  # noqa: E402, F401  registers the queries

__all__ = ["ORACLE", "QUERIES"]
