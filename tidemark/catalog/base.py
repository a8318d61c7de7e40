"""Registry of runnable queries with, where one exists, an equivalent ANSI SQL text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ready


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(lambda spark, sf: fn(ready(spark), sf), sql)
        return fn
    return add


def with_(*ctes: str) -> str:
    """Prefix of a statement that uses the given common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"
