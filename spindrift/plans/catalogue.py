"""Every registered query with its SQL."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("search_queries", "tracing_queries", "corpus_queries", "routing_queries", "graph_queries", "dialog_queries", "chunk_queries", "retrieval_queries", "driver_queries", "table_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)


def examples() -> tuple[dict, dict[str, str]]:
    """Queries over literal rows, and their SQL: tests, not registered queries."""
    _load()
    return dict(registry.EXAMPLES), dict(registry.EXAMPLE_SQL)
