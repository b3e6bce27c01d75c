"""JSON documents: nested forecasts keyed by item, record lists, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillwise.operators.encoding import decode_items
from tillwise.schemas import ENCODER_DOCUMENT


def read_keyed(spark: SparkSession, path: str, schema: T.MapType) -> DataFrame:
    """One row per entry of a ``{key: value}`` JSON document (or many such files)."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", schema)).alias("key", "value"))
    if isinstance(schema.valueType, T.StructType):
        return entries.select("key", "value.*")
    return entries


def read_encoder(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, ENCODER_DOCUMENT).select(
        F.col("key").alias("SubcategoryName"), F.col("value").alias("id")
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """Records as JSON lines, or as one array per file with ``lines=False``."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """One JSON line ``{key: {...}}`` per row, readable by :func:`read_keyed` line by line."""
    rest = [c for c in df.columns if c != key]
    entry = F.create_map(F.col(key).cast("string"), F.struct(*rest))
    df.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def read_keyed_lines(spark: SparkSession, path: str, schema: T.MapType) -> DataFrame:
    """Counterpart of :func:`write_keyed`: a splittable scan, one entry per line."""
    entries = spark.read.text(path).select(F.explode(F.from_json("value", schema)).alias("key", "value"))
    return entries.select("key", "value.*")


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def decode_documents(documents: DataFrame, mapping: DataFrame, key: str = "key") -> DataFrame:
    """Replace document keys by item names.

    Documents that carry an ``item_id`` are decoded by it and also gain an
    ``item_name``; others are decoded by their key.
    """
    if "item_id" in documents.columns:
        named = decode_items(documents, mapping, "item_id", "item_name")
        return named.withColumn(key, F.col("item_name"))
    return decode_items(documents, mapping, key, "_decoded").withColumn(key, F.col("_decoded")).drop("_decoded")
