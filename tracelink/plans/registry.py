"""All queries of the library's own operators, and their SQL twins."""

from __future__ import annotations

import importlib

#: Modules that hold QUERIES (name -> function of session and folder) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = ("filter_text", "joining", "volumes", "linking", "storing")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tracelink.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
