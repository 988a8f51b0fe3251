"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans.adapters import VIEWS, Tables

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(tables)` under `name`, with SQL over the adapter views when it has any."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = expand(sql)
        return fn

    return add


def expand(sql: str) -> str:
    """Prepend the adapter views a statement names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if re.search(rf"\b{view}\b", text) and view not in needed:
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    head = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    body = sql.strip()
    if not head:
        return body
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{head},\n{body[len(lead):]}"
    return f"WITH {head}\n{body}"
