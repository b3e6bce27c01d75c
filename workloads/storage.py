"""Round trips through the sources and sinks, and saved models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tillwise.operators import evaluate, regress
from tillwise.operators import panel as panels
from tillwise.sources import documents, keyed, models, tables
from tillwise.session import cut_lineage, shared_folder
from workloads.forecasting import ITEM, MODEL_FEATURES, daily_a, panel_a
from workloads.registry import PARTS, Tables, query

RETURNS_CSV = T.StructType().add("ReturnDate", "string").add("ProductKey", "long").add("ReturnQuantity", "integer")
ITEM_DAYS = T.MapType(T.StringType(), T.StructType().add("units", "long").add("days", T.MapType(T.StringType(), T.LongType())))


def folder(t: Tables, label: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT * FROM returns")
def _(t: Tables):
    """Written with date texts, read again as many files by one pattern."""
    place = folder(t, "returns-csv")
    tables.write_csv(t.returns, place)
    back = tables.read_csv(t.spark, f"{place}/part-*.csv", RETURNS_CSV)
    return back.withColumn("ReturnDate", F.to_date("ReturnDate", "dd-MM-yyyy"))


@query("csv_as_view", "SELECT ProductKey, CAST(sum(ReturnQuantity) AS BIGINT) AS units, count(*) AS lines FROM returns GROUP BY 1")
def _(t: Tables):
    place, name = folder(t, "returns-csv"), f"returns_{uuid.uuid4().hex}"
    tables.write_csv(t.returns, place)
    tables.register_tables(t.spark, {name: place}, {name: RETURNS_CSV})
    return t.spark.sql(f"SELECT ProductKey, sum(ReturnQuantity) AS units, count(*) AS lines FROM {name} GROUP BY ProductKey")


@query("json_records", "SELECT * FROM returns")
def _(t: Tables):
    place = folder(t, "returns-json")
    documents.write_records(t.returns, place)
    return documents.read_records(t.spark, place, t.returns.schema)


def item_days(t: Tables) -> DataFrame:
    """Per item its units and the units of each day, as a nested value."""
    day = F.struct(F.col("OrderDate").cast("string"), F.col("OrderQuantity").cast("long"))
    known = daily_a(t).filter(F.col(ITEM).isNotNull())
    return known.groupBy(ITEM).agg(F.sum("OrderQuantity").alias("units"), F.map_from_entries(F.array_sort(F.collect_list(day))).alias("days"))


def flat_days(entries: DataFrame) -> DataFrame:
    days = entries.select(F.col("key").alias(ITEM), "units", F.explode("days").alias("day", "day_units"))
    return days.withColumn("day", F.to_date("day"))


PARTS["item_days"] = """SELECT SubcategoryName, CAST(sum(OrderQuantity) OVER (PARTITION BY SubcategoryName) AS BIGINT) AS units, OrderDate AS day,
      OrderQuantity AS day_units FROM dly WHERE SubcategoryName IS NOT NULL"""


@query("keyed_lines", "SELECT * FROM item_days")
def _(t: Tables):
    place = folder(t, "item-lines")
    documents.write_keyed(item_days(t), place, ITEM)
    return flat_days(documents.read_keyed_lines(t.spark, place, ITEM_DAYS))


@query("keyed_documents", "SELECT * FROM item_days")
def _(t: Tables):
    """One JSON object per file, each read by as many tasks as it has splits."""
    place = folder(t, "item-documents")
    keyed.write_keyed_documents(item_days(t), place, ITEM, documents=4)
    return flat_days(keyed.read_keyed_split(t.spark, place, ITEM_DAYS))


@query(
    "model_generations",
    """SELECT CategoryName, event, 2 AS generation, round(regr_intercept(profit, OrderQuantity) + 10 * regr_slope(profit, OrderQuantity), 3) AS profit_at_10
       FROM price_events GROUP BY 1, 2""",
)
def _(t: Tables):
    """The second generation is read: the first is older, the third was never published."""
    place = folder(t, "lines")
    lines = cut_lineage(regress.simple_line(t.price_events, ["CategoryName", "event"], "OrderQuantity", "profit"))
    first = models.table_or_train(t.spark, place, lambda: lines.withColumn("slope", F.lit(0.0)))
    models.save_model_table(first.drop("generation", "slope").join(lines.select("CategoryName", "event", "slope"), ["CategoryName", "event"]), place, 2)
    lines.withColumn("slope", F.lit(-1.0)).write.parquet(f"{place}/data/unfinished")
    profit = F.round(F.col("intercept") + 10 * F.col("slope"), 3).alias("profit_at_10")
    return models.load_model_table(t.spark, place).select("CategoryName", "event", "generation", profit)


# The saved pipeline must score every row as the fitted one does.
@query("pipeline_generations", "SELECT OrderDate, SubcategoryName, true AS same FROM pnl")
def _(t: Tables):
    place = folder(t, "demand-model")
    table = cut_lineage(panels.feature_table(panel_a(t), log_target=False))
    fitted = evaluate.demand_model(table, MODEL_FEATURES, "OrderQuantity", "poisson")
    saved = models.pipeline_or_train(t.spark, place, lambda: fitted)
    both = saved.transform(fitted.transform(table).withColumnRenamed("pred", "before").drop("_features"))
    return both.select("OrderDate", ITEM, (F.col("pred") == F.col("before")).alias("same"))
