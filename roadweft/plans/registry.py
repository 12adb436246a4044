"""Every query of the engine with its DuckDB equivalent, by the operator's ID."""

from __future__ import annotations

import importlib

# a later module's query replaces an earlier one of the same name
MODULES = ("labels", "raster", "geometry", "graph", "kernels", "lines", "storage", "numbered", "operators", "tables")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"roadweft.plans.{name}"), attribute)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
