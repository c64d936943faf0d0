"""Queries by name, with their SQL where there is any."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixtures import SQL_VIEWS

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def n_rows() -> Column:
    return F.count(F.lit(1))


def oracle(body: str) -> str:
    """``body`` with the fixture views that it names, as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL_VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL_VIEWS[name])
                needed.append(name)

    need(body)
    body = body.strip()
    views = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in needed)
    if not views:
        return body
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame``."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep
