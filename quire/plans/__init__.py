"""Registered queries of the core, with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("segments", "texts", "figures", "records", "relational", "packed")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"quire.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"quire.plans.{m}").ORACLE.items()}
