"""Every query of the street-safety operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from kerbline.plans import registry

_MODULES: tuple[str, ...] = ("network_queries", "spatial_queries", "graph_queries", "route_queries", "ride_queries", "feature_queries", "detail_queries", "imagery_queries", "sql_queries")


def _load() -> None:
    for module in _MODULES:
        import_module(f"kerbline.plans.{module}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.ORACLES)
