"""CSV and parquet tables: latin-1 input with fixed schemas, dated output."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql import types as T

from tillwise.functions.text import na_to_null
from tillwise.operators.clean import as_csv_dates


def _csv_reader(spark: SparkSession, encoding: str) -> DataFrameReader:
    return spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')


def csv_header(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1") -> list[str]:
    """Column names found in the (first) file; its number is the width that a schema report compares."""
    return _csv_reader(spark, encoding).csv(path).columns


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Read one file, a list or a glob (many files are one partitioned scan).

    Columns are matched by header name, in any order; more columns than the schema names are left
    out, a missing one is an error, and so is a file whose header differs from the first one's. Usual
    missing-value texts become NULL before numbers are cast, so a stray token cannot fail the read.
    """
    header = csv_header(spark, path, encoding)
    if missing := [f.name for f in schema.fields if f.name not in header]:
        raise ValueError(f"{path} lacks the columns {missing}; it has {header}")
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = _csv_reader(spark, encoding).schema(as_text).option("enforceSchema", False).csv(path)
    return raw.select(
        *[
            na_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else na_to_null(F.col(f.name)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_cleaned(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read a cleaned parquet table; a column list prunes the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_csv(df: DataFrame, path: str, date_text: bool = True) -> None:
    """Write with a header; dates become ``DD-MM-YYYY`` text only here."""
    out = as_csv_dates(df) if date_text else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_cleaned(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def cleaned_name(raw_name: str) -> str:
    """Name of the cleaned counterpart of a raw table."""
    stem = raw_name.rsplit("/", 1)[-1].removesuffix(".csv")
    return f"Cleaned_{stem.split('_', 1)[-1]}"


def register_tables(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType]) -> list[str]:
    """Expose each named CSV as a temporary view."""
    for name, path in paths.items():
        read_csv(spark, path, schemas[name]).createOrReplaceTempView(name)
    return list(paths)
