"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for each node that has a link to another.

    Nulls and self links are ignored; no edges give no rows. Only edges move; a hub's edges are combined
    before the shuffle that finds its smallest neighbour, and the join back to it may be split.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    linked = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    now = staged(edges.where(linked).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.toDF("u", "v"))
        now = staged(small.where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
