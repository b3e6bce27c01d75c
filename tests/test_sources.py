"""Readers and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise import schemas
from tillwise.operators import forecast, profile
from tillwise.sources import documents, keyed, models, tables


def test_csv_round_trip_with_na_tokens_and_latin1(spark, tmp_path):
    for i, body in enumerate(("1,Caf\xe9,NA,8,12.5,\n", "x,n/a,Red,7,NaN,\n")):
        (tmp_path / f"Sales{i}.csv").write_bytes(("k,name,colour,n,price,note\n" + body).encode("latin-1"))
    schema = schemas._struct("k:i name:s colour:s n:l price:d note:s")
    rows = tables.read_csv(spark, f"{tmp_path}/Sales*.csv", schema).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(None, None, "Red", 7, None, None), (1, "Caf\xe9", None, 8, 12.5, None)]
    day = spark.createDataFrame([(dt.date(2017, 6, 5), 1)], "d date, v int")
    tables.write_csv(day, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first().d == "05-06-2017"
    tables.write_cleaned(day, f"{tmp_path}/clean")
    assert tables.read_cleaned(spark, f"{tmp_path}/clean", ["v"]).columns == ["v"]
    assert tables.cleaned_name("data/Shop_Products.csv") == "Cleaned_Products"


def test_csv_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("price,extra,name\n2.5,x,Pump\n")
    schema = schemas._struct("name:s price:d")
    assert tuple(tables.read_csv(spark, f"{tmp_path}/p.csv", schema).first()) == ("Pump", 2.5)
    assert len(tables.csv_header(spark, f"{tmp_path}/p.csv")) == 3
    report = profile.schema_report({"p": tables.read_csv(spark, f"{tmp_path}/p.csv", schema)}, {"p": 2}, {"p": 3}).first()
    assert (report.found_columns, report.matches) == (3, False)
    with pytest.raises(ValueError, match="lacks the columns"):
        tables.read_csv(spark, f"{tmp_path}/p.csv", schemas._struct("name:s cost:d"))


def test_tables_as_views(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ProductCategoryKey,CategoryName\n1,Bikes\n")
    tables.register_tables(spark, {"category_view": f"{tmp_path}/c.csv"}, {"category_view": schemas.RAW_CATEGORIES})
    assert spark.sql("SELECT CategoryName FROM category_view").first()[0] == "Bikes"


def test_forecast_documents(spark, tmp_path):
    rows = [("1", "ColdStart", "Low (60-65%)", dt.date(2017, 7, d), float(d)) for d in (1, 2, 3)]
    daily = spark.createDataFrame(rows, "SubcategoryName string, model_source string, confidence_level string, date date, qty double")
    docs = forecast.forecast_documents(daily)
    documents.write_keyed(docs, f"{tmp_path}/f", "item_id")
    back = documents.read_keyed_lines(spark, f"{tmp_path}/f", schemas.FORECAST_DOCUMENT).collect()
    assert back[0].key == "1" and back[0].daily_forecast["2017-07-02"] == 2.0 and back[0].total_horizon_volume == 6.0
    again = forecast.documents_to_daily(docs).agg(F.sum("qty")).first()[0]
    assert again == 6.0


def test_decode_documents(spark, tmp_path):
    doc = {
        "21": {"item_id": "21", "forecasted_sales_total": 305.01, "safety_stock_estimate": 45.75, "total_stock_recommendation": 350.76,
               "model_used": "AutoARIMA", "stock_logic": "Error-Adjusted"},
        "99": {"item_id": "99", "forecasted_sales_total": 0.0, "safety_stock_estimate": 0.0, "total_stock_recommendation": 0.0,
               "model_used": "ColdStart", "stock_logic": "Volatility-Adjusted"},
    }
    (tmp_path / "stock.json").write_text(json.dumps(doc, indent=4))
    (tmp_path / "codes.json").write_text(json.dumps({"Mountain Bikes": 21}))
    mapping = documents.read_encoder(spark, f"{tmp_path}/codes.json")
    stock = documents.read_keyed(spark, f"{tmp_path}/stock.json", schemas.STOCKING_DOCUMENT)
    got = {r.key: (r.item_name, r.item_id) for r in documents.decode_documents(stock, mapping).collect()}
    assert got == {"Mountain Bikes": ("Mountain Bikes", "21"), "Unknown_ID_99": ("Unknown_ID_99", "99")}
    plain = spark.createDataFrame([("21", 1.0)], "key string, v double")
    assert documents.decode_documents(plain, mapping).first().key == "Mountain Bikes"
    documents.write_records(plain, f"{tmp_path}/r")
    assert documents.read_records(spark, f"{tmp_path}/r", plain.schema).count() == 1


def test_model_generations(spark, tmp_path):
    path = f"{tmp_path}/m"
    assert not models.has_model(spark, path)
    for g in (1, 2):
        models.save_model_table(spark.createDataFrame([("a", float(g))], "k string, c double"), path, g)
    assert models.has_model(spark, path)
    assert models.load_model_table(spark, path).first().c == 2.0
    assert models.load_model_table(spark, path, 1).first().c == 1.0


def test_unpublished_generations_are_never_read(spark, tmp_path):
    path = f"{tmp_path}/m"

    def table(c):
        return spark.createDataFrame([("a", c)], "k string, c double")

    def broken():
        raise RuntimeError("fit failed")

    with pytest.raises(LookupError):
        models.load_model_table(spark, path)
    table(9.0).write.parquet(f"{path}/data/half")
    assert not models.has_model(spark, path)
    with pytest.raises(RuntimeError):
        models.table_or_train(spark, path, broken)
    assert not models.has_model(spark, path) and models.generations(spark, path).collect() == []
    assert models.table_or_train(spark, path, lambda: table(1.0)).first().c == 1.0
    assert models.table_or_train(spark, path, broken).first().c == 1.0
    before = models.load_model_table(spark, path, 1)
    models.save_model_table(table(1.5), path, 1)
    models.save_model_table(table(3.0).withColumn("extra", F.lit(1)), path, 3)
    assert before.first().c == 1.0 and models.load_model_table(spark, path, 1).first().c == 1.5
    assert models.load_model_table(spark, path).first().asDict() == {"k": "a", "c": 3.0, "extra": 1, "generation": 3}
    assert not models.has_model(spark, path, "pipeline")
    with pytest.raises(LookupError):
        models.load_model_table(spark, path, 2)


def test_one_document_read_by_several_tasks(spark, tmp_path):
    value = T.StructType().add("a", "string").add("b", T.ArrayType(T.IntegerType())).add("c", T.MapType(T.StringType(), T.StringType()))
    schema = T.MapType(T.StringType(), value)
    doc = {
        f'k"{i}, \\ {{é': {"a": 'x,"]}\\' * (i % 7) + "\n", "b": list(range(i % 5)), "c": {"u": "{[,", 'v\\"': "日本"}} for i in range(40)
    }
    doc["long"] = {"a": "z," * 1500, "b": [], "c": {}}
    (tmp_path / "in").mkdir()
    bodies = [json.dumps(doc, ensure_ascii=False), json.dumps(doc, indent=4) + "\n", " {}\n", "", '{"one": {"a": null}}', '\ufeff{"two": {"a": ","}}']
    for i, body in enumerate(bodies):
        (tmp_path / "in" / f"{i}.json").write_text(body, encoding="utf-8")
    expected = [(k, v.get("a"), v.get("b"), v.get("c")) for d in (doc, doc, {"one": {"a": None}}, {"two": {"a": ","}}) for k, v in d.items()]
    sizes = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        for size, limit in (("1m", 100), ("701b", 1000), ("701b", 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert size == "1m" or spark.read.option("lineSep", ",").text(f"{tmp_path}/in/0.json").rdd.getNumPartitions() > 5
            got = [(r.key, r.a, r.b, r.c) for r in keyed.read_keyed_split(spark, f"{tmp_path}/in", schema, limit).collect()]
            assert sorted(map(str, got)) == sorted(map(str, expected)), size
    finally:
        for c, v in sizes.items():
            spark.conf.set(c, v)
