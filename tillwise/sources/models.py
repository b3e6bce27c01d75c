"""Fitted models in generations: data is written first, a one-row manifest then publishes it.

``data/<id>`` holds a table or a pipeline, ``manifest/generation=<n>`` names the published ones. Only what a manifest names is
ever read, so a write that fails half-way, or one still running, stays unseen. Publishing a generation again adds a
manifest; the newest counts, and readers of the older one keep their data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

_MANIFEST = "published long, kind string, location string, columns string"
_TABLE, _PIPELINE = "table", "pipeline"


def _place(path: str) -> tuple[str, str]:
    """A new location below ``path``, relative and whole."""
    location = f"data/{uuid.uuid4().hex}"
    return location, f"{path.rstrip('/')}/{location}"


def _publish(spark: SparkSession, path: str, generation: int, kind: str, location: str, columns: str | None) -> None:
    entry = spark.createDataFrame([(time.time_ns(), kind, location, columns)], _MANIFEST).coalesce(1)
    entry.withColumn("generation", F.lit(generation).cast("long")).write.mode("append").partitionBy("generation").json(f"{path.rstrip('/')}/manifest")


def generations(spark: SparkSession, path: str) -> DataFrame:
    """All published (generation, published, kind, location, columns); empty if there are none."""
    schema = f"{_MANIFEST}, generation long"
    place = f"{path.rstrip('/')}/manifest"
    if not _exists(spark, place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(place)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _published(spark: SparkSession, path: str, kind: str, generation: int | None) -> Row | None:
    """The newest manifest of a generation, or of the newest generation."""
    known = generations(spark, path).filter(F.col("kind") == kind)
    if generation is not None:
        known = known.filter(F.col("generation") == generation)
    return known.orderBy(F.desc("generation"), F.desc("published"), "location").first()


def _named(spark: SparkSession, path: str, kind: str, generation: int | None) -> Row:
    found = _published(spark, path, kind, generation)
    if found is None:
        raise LookupError(f"no published {kind} in {path}" + ("" if generation is None else f" of generation {generation}"))
    return found


def save_model_table(table: DataFrame, path: str, generation: int) -> None:
    """Write one generation of coefficients and publish it; a rerun replaces it for later readers."""
    location, place = _place(path)
    table.write.parquet(place)
    _publish(table.sparkSession, path, generation, _TABLE, location, table.schema.json())


def load_model_table(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """A given generation, or the newest published one, with its ``generation``."""
    found = _named(spark, path, _TABLE, generation)
    table = spark.read.schema(T.StructType.fromJson(json.loads(found.columns))).parquet(f"{path.rstrip('/')}/{found.location}")
    return table.withColumn("generation", F.lit(found.generation).cast("int"))


def save_pipeline(spark: SparkSession, model: PipelineModel, path: str, generation: int) -> None:
    """Write a fitted pipeline as a generation and publish it."""
    location, place = _place(path)
    model.write().save(place)
    _publish(spark, path, generation, _PIPELINE, location, None)


def load_pipeline(spark: SparkSession, path: str, generation: int | None = None) -> PipelineModel:
    found = _named(spark, path, _PIPELINE, generation)
    return PipelineModel.load(f"{path.rstrip('/')}/{found.location}")


def has_model(spark: SparkSession, path: str, kind: str = _TABLE) -> bool:
    """Whether a model of this kind has been published at ``path``."""
    return _published(spark, path, kind, None) is not None


def table_or_train(spark: SparkSession, path: str, train: Callable[[], DataFrame]) -> DataFrame:
    """The newest published table; if there is none, ``train()`` is run, saved as generation 1 and read back."""
    if not has_model(spark, path):
        save_model_table(train(), path, 1)
    return load_model_table(spark, path)


def pipeline_or_train(spark: SparkSession, path: str, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The newest published pipeline; if there is none, ``train()`` is run, saved as generation 1 and read back."""
    if not has_model(spark, path, _PIPELINE):
        save_pipeline(spark, train(), path, 1)
    return load_pipeline(spark, path)
