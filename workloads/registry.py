"""Registry of checked queries: a Spark callable and, where possible, its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloads.bindings import VIEWS, view, view_closure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Reusable oracle fragments, written independently of the Spark operators.
PARTS: dict[str, str] = {}


def solved(rows: str, keys: str = "") -> str:
    """SQL of (keys, m): Gauss-Jordan elimination on each matrix ``m`` (a list of rows) of the fragment ``rows``.

    The left square block becomes the identity, so columns beyond it hold the solutions.
    """
    k = keys + ", " if keys else ""
    return f"""SELECT {k}m FROM (WITH RECURSIVE gj AS (
        SELECT {k}1 AS s, m FROM {rows}
        UNION ALL
        SELECT {k}s + 1, list_transform(m, lambda row, r: list_transform(row, lambda v, c:
               CASE WHEN r = s THEN v / m[s][s] ELSE v - row[s] * m[s][c] / m[s][s] END)) FROM gj WHERE s <= len(m))
      SELECT {k}m FROM gj WHERE s = len(m) + 1) solved"""


class Tables:
    """Bound views of one session and scale folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)


def _parts_for(sql: str) -> list[str]:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = re.sub(r"'[^']*'", "", todo.pop())
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(PARTS[name])
    return [p for p in PARTS if p in needed]


def oracle_text(sql: str) -> str:
    """Prefix a statement with the views and fragments it uses."""
    parts = _parts_for(sql)
    views = view_closure(sql + " " + " ".join(PARTS[p] for p in parts))
    ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in views] + [f"{p} AS ({PARTS[p].strip()})" for p in parts]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + sql.strip()


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its oracle SQL, if any."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return fn

    return add
