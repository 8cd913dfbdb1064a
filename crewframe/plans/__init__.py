"""Queries over the given tables."""

from __future__ import annotations

MODULES = ["pay_queries", "audit_queries", "people_queries", "schema_queries", "stream_queries"]


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"crewframe.plans.{name}")


def queries() -> dict:
    from crewframe.plans import registry

    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    from crewframe.plans import registry

    _load()
    return dict(registry.ORACLE)
