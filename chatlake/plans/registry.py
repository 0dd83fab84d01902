"""All queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["problems", "activity", "search"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"chatlake.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"chatlake.plans.{name}").SQL
    return found
