"""Registered queries and their reference SQL."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefix the named views a statement uses, each after the views it uses itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, view in CTES.items():
            if name not in ordered and view is not text and re.search(rf"\b{name}\b", text):
                visit(view)
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register
