"""Bindings of the operators to the given tables."""
from __future__ import annotations

import importlib

MODULES = ("scans", "predicates", "joins", "aggregates", "ordering", "scalars", "models", "jobs", "streams")


def all_bindings():
    """Queries and SQL of every module, in registration order."""
    from bindings.registry import ORACLE, QUERIES, with_ctes

    for name in MODULES:
        importlib.import_module(f"bindings.{name}")
    return dict(QUERIES), {name: with_ctes(body) for name, body in ORACLE.items()}
