"""The list of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> None:
    for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", sql)):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            if word not in seen:
                seen.append(word)


def full_sql(name: str) -> str:
    """A query's SQL with the shared named subqueries it uses put in front."""
    order: list[str] = []
    _needed(SQL[name], order)
    if not order:
        return SQL[name]
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = SQL[name].strip()
    if body.lower().startswith("with recursive"):
        return f"WITH RECURSIVE {parts},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
