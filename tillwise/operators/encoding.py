"""Persistent item numbers and their reversal in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.operators.ordering import global_index


def extend_encoding(mapping: DataFrame | None, *names: DataFrame) -> DataFrame:
    """Keep known ids; unseen names get the next ids in alphabetical order.

    ``mapping`` is (SubcategoryName, id) or None; each names table has a
    SubcategoryName column; a missing name counts as ``Unknown`` and is numbered
    like any other. New names are numbered per prefix with an offset per prefix, so
    numbering a large vocabulary stays distributed.
    """
    seen = names[0].select("SubcategoryName")
    for more in names[1:]:
        seen = seen.union(more.select("SubcategoryName"))
    seen = seen.select(F.coalesce("SubcategoryName", F.lit("Unknown")).alias("SubcategoryName")).distinct()
    prefix = F.substring("SubcategoryName", 1, 8)
    if mapping is None:
        return global_index(seen, prefix, ["SubcategoryName"], "id").select(
            "SubcategoryName", F.col("id").cast("int").alias("id")
        )
    known = mapping.select("SubcategoryName", F.col("id").cast("int").alias("id"))
    start = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    fresh = global_index(
        seen.join(known, "SubcategoryName", "left_anti"), prefix, ["SubcategoryName"], "id"
    )
    return known.unionByName(
        fresh.select("SubcategoryName", (F.col("id") + start).cast("int").alias("id"))
    )


def encode_items(df: DataFrame, mapping: DataFrame, replace: bool = True) -> DataFrame:
    """Replace SubcategoryName by its id, or add it as SubcategoryEncoded.

    A missing name counts as ``Unknown`` when names are replaced.
    """
    table = mapping.select("SubcategoryName", F.col("id").alias("SubcategoryEncoded"))
    if replace:
        df = df.withColumn("SubcategoryName", F.coalesce("SubcategoryName", F.lit("Unknown")))
    joined = df.join(table, "SubcategoryName", "left")
    if not replace:
        return joined
    return joined.withColumn("SubcategoryName", F.col("SubcategoryEncoded")).drop("SubcategoryEncoded")


def decode_items(df: DataFrame, mapping: DataFrame, id_column: str, name_column: str = "item_name") -> DataFrame:
    """Names for ids; an id without a name reads ``Unknown_ID_<id>``."""
    table = mapping.select(F.col("id").cast("string").alias("_id"), F.col("SubcategoryName").alias("_name"))
    key = F.col(id_column).cast("string")
    return (
        df.join(table, key == F.col("_id"), "left")
        .withColumn(name_column, F.coalesce("_name", F.concat(F.lit("Unknown_ID_"), key)))
        .drop("_id", "_name")
    )


def ordinal_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Alphabetical codes 0.. of a category column."""
    codes = extend_encoding(None, df.select(F.col(column).alias("SubcategoryName")))
    return df.join(
        codes.select(F.col("SubcategoryName").alias(column), F.col("id").alias(name)), column, "left"
    )


def one_hot(column: Column, categories: list[str], drop_first: bool = True) -> list[Column]:
    """0/1 columns for a known list of categories (first one dropped)."""
    chosen = categories[1:] if drop_first else categories
    return [F.when(column == c, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"is_{c}") for c in chosen]


def min_max(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale columns to 0..1 with bounds taken from ``fit_on`` (default: itself)."""
    base = fit_on if fit_on is not None else df
    stats = base.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
        )
    ).scalar()
    for c in columns:
        lo, hi = stats.getField(f"lo_{c}"), stats.getField(f"hi_{c}")
        width = F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo).cast("double"))
        df = df.withColumn(c, (F.col(c) - lo) / width)
    return df
