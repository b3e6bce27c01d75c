"""Side-by-side comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

from pyspark.sql import DataFrame


def plain(value):
    """Engine-neutral form of a cell; integral doubles and integers are alike."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
