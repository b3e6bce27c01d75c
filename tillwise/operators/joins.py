"""Joining facts to the product hierarchy and other keyed tables.

No side is broadcast by hint: a dimension may be large, so the choice is left to
size-based planning, with adaptive skew splitting for hot product keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def product_items(products: DataFrame, subcategories: DataFrame) -> DataFrame:
    """ProductKey -> SubcategoryName (NULL when the subcategory is unknown)."""
    return products.select("ProductKey", "ProductSubcategoryKey").join(
        subcategories.select("ProductSubcategoryKey", "SubcategoryName"),
        "ProductSubcategoryKey",
        "left",
    ).select("ProductKey", "SubcategoryName")


def enrich_sales(sales: DataFrame, products: DataFrame, subcategories: DataFrame) -> DataFrame:
    """Sale lines with their subcategory; orphan products stay with a NULL name."""
    return sales.join(product_items(products, subcategories), "ProductKey", "left")


def daily_by_item(
    facts: DataFrame,
    items: DataFrame,
    day: str,
    sums: Sequence[str],
    mins: Sequence[str] = (),
) -> DataFrame:
    """Daily totals per item, aggregated per product *before* the dimension join.

    The pre-aggregation bounds rows per product by the number of days, so a
    product owning a third of all sales does not skew the join. Rows without an
    item are left out.
    """
    per_product = facts.groupBy(day, "ProductKey").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins]
    )
    return (
        per_product.join(items, "ProductKey")
        .filter(F.col("SubcategoryName").isNotNull() & F.col(day).isNotNull())
        .groupBy(day, "SubcategoryName")
        .agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins])
    )


def look_up(
    df: DataFrame, table: DataFrame, on: Sequence[str], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Left join to a keyed table, with a default for columns that found no match."""
    joined = df.join(table, list(on), "left")
    for column, value in (defaults or {}).items():
        joined = joined.withColumn(column, F.coalesce(F.col(column), value))
    return joined


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def key_set(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set union, intersection or difference of two one-column key tables."""
    if how == "union":
        return a.union(b).distinct()
    if how == "intersect":
        return a.intersect(b)
    if how == "difference":
        return a.subtract(b)
    raise ValueError(f"unknown set operation: {how}")
