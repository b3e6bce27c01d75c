"""Rows derived by hand from the cleaning rules on tiny literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from tillwise.operators import clean


def test_customers_keep_only_the_valid_row(spark):
    schema = (
        "FirstName string, LastName string, Prefix string, MaritalStatus string, Gender string, BirthDate string, "
        "EducationLevel string, Occupation string, HomeOwner string, AnnualIncome string, EmailAddress string, "
        "TotalChildren int, ExtraCol int"
    )
    rows = [
        ("John", "Doe", None, "S", None, "1980-01-01", "Bachelors", "Professional", "Y", "$50,000", "john@test.com", 2, 1),
        ("Jane", "Smith", "MRS.", "M", "F", "1850-01-01", "High School", "Clerical", "N", "$60,000", "jane@test.com", 1, 2),
        ("Invalid123", "Doe", "MR.", "S", "M", "1990-01-01", "Bachelors", "Professional", "Y", "$70,000", "bad_email", 20, 3),
        (None, None, "MR.", "S", "M", "1990-01-01", "Bachelors", "Professional", "Y", "$70,000", "valid@test.com", 0, 4),
    ]
    names = spark.createDataFrame([("John", "male")], "first_name string, gender string")
    out = clean.customers(spark.createDataFrame(rows, schema), names).collect()
    assert [(r.FirstName, r.Gender, r.Prefix, r.AnnualIncome) for r in out] == [("John", "M", "MR.", 50000.0)]


def test_products_colours_and_price_tails(spark):
    names = ["Silver Bike", "Red Bike", "Blue Helmet", "Black Jersey", "Silver Lock", "Yellow Bell", "Grey Pump"]
    colours = [None, "Red", None, "Black", None, "Yellow", "Grey"]
    sizes = ["L", "XL", "62", "M", "S", "44", "52"]
    styles = ["U", "M", "0", "W", "U", "M", "0"]
    costs = [100.0, 100.0, 101.0, 100.0, 100.0, 99.0, 100.0]
    prices = [150.0, 150.0, 151.0, 150.0, 150.0, 149.0, 150.0]
    rows = [
        (i + 1, "SKU", names[i], "M1", "D", colours[i], sizes[i], styles[i], costs[i], prices[i], i + 1) for i in range(7)
    ]
    schema = (
        "ProductKey int, ProductSKU string, ProductName string, ModelName string, ProductDescription string, "
        "ProductColor string, ProductSize string, ProductStyle string, ProductCost double, ProductPrice double, "
        "ProductSubcategoryKey int"
    )
    out = clean.products(spark.createDataFrame(rows, schema)).orderBy("ProductKey").collect()
    assert [(r.ProductKey, r.ProductColor) for r in out] == [
        (1, "Silver"), (2, "Red"), (4, "Black"), (5, "Silver"), (7, "Grey"),
    ]


def test_calendar_guardrail_and_formats(spark):
    late = spark.createDataFrame([("2023-02-13",), ("01-2023-02",), ("6-25-2021",), (None,)], "Date string")
    assert clean.calendar(late).count() == 0
    fine = spark.createDataFrame(
        [("2016-03-04",), ("05-03-2016",), ("25/12/2016",), ("3-25-2017",), ("31-02-2016",), ("junk",), (None,)], "Date string"
    )
    got = sorted(r.Date for r in clean.calendar(fine).collect())
    assert got == [dt.date(2016, 3, 4), dt.date(2016, 3, 5), dt.date(2016, 12, 25), dt.date(2017, 3, 25)]


def test_names_without_digits(spark):
    subs = spark.createDataFrame(
        [(1, " Mountain Bikes ", 1), (2, "Road Bikes", 1), (3, "Bikes123", 1), (4, None, 1), (5, "Wheels", 2)],
        "SubcategoryKey int, SubcategoryName string, CategoryKey int",
    )
    assert sorted(r.SubcategoryName for r in clean.subcategories(subs).collect()) == ["Mountain Bikes", "Road Bikes", "Wheels"]
    cats = spark.createDataFrame([(1, " Bikes "), (2, "Components"), (3, "Clothing1"), (4, None)], "k int, CategoryName string")
    assert sorted(r.CategoryName for r in clean.categories(cats).collect()) == ["Bikes", "Components"]


def test_territories_need_country_or_region(spark):
    rows = [
        (1, " Northwest ", "United States", "North America"), (2, "Central", "United States", "North America"),
        (3, None, None, "Unknown"), (4, None, "France", "Europe"),
    ]
    out = clean.territories(spark.createDataFrame(rows, "SalesTerritoryKey int, Region string, Country string, Continent string"))
    assert sorted((r.SalesTerritoryKey, r.Region) for r in out.collect() if r.Region) == [(1, "Northwest"), (2, "Central")]
    assert sorted(r.SalesTerritoryKey for r in out.collect()) == [1, 2, 4]


SALES = (
    "OrderDate string, StockDate string, OrderNumber string, ProductKey int, CustomerKey int, TerritoryKey int, "
    "OrderLineItem int, OrderQuantity int"
)


def test_sales_future_rows_and_merging(spark):
    late = [("2023-01-01", "2022-12-01", " SO123 ", 101, 500, 1, 1, 1), ("02-01-2023", "2022-12-01", "SO456", 102, 501, 1, 1, 2)]
    assert clean.sales(spark.createDataFrame(late, SALES)).count() == 0
    rows = [
        ("2016-05-01", "2016-01-01", " SO1 ", 1, 9, 1, 2, 3),
        ("01-05-2016", "2015-12-01", "SO1", 1, 9, 1, 1, 4),
        ("13/06/2016", "2016-01-01", "SO2", 1, 9, None, 1, 4),
        ("6-25-2016", "2016-01-01", "SO3", 2, 9, 1, 1, 2),
        ("2016-07-01", "2016-01-01", "SO4", 3, 9, 1, 1, 900),
    ]
    out = clean.sales(spark.createDataFrame(rows, SALES)).orderBy("OrderDate").collect()
    assert [(r.OrderNumber, r.OrderQuantity, r.StockDate, r.OrderLineItem) for r in out] == [
        ("SO1", 7, dt.date(2015, 12, 1), 1), ("SO3", 2, dt.date(2016, 1, 1), 1),
    ]


def test_returns_outlier(spark):
    quantities = [1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 500]
    rows = [("2023-01-01" if i < 19 else "2023-01-05", 1, 100, q) for i, q in enumerate(quantities)]
    out = clean.returns(spark.createDataFrame(rows, "ReturnDate string, TerritoryKey int, ProductKey int, ReturnQuantity int"))
    assert sorted(r.ReturnQuantity for r in out.collect()) == [1, 2]
    text = clean.as_csv_dates(out).select("ReturnDate").distinct().collect()
    assert [r.ReturnDate for r in text] == ["01-01-2023"]


def test_price_events(spark):
    rows = [("A", "10", "2", 1.0, " No Promo "), ("A", "10", "2", 1.0, " No Promo "), ("A", "x", "2", 1.0, "e"), ("A", None, "2", 1.0, "e")]
    out = clean.price_events(
        spark.createDataFrame(rows, "CategoryName string, ProductPrice string, OrderQuantity string, profit double, event string")
    )
    assert [tuple(r) for r in out.collect()] == [("A", 10.0, 2.0, 1.0, "No Promo")]


def test_age_rule_is_conditional(spark):
    df = spark.createDataFrame([(1, dt.date(1980, 1, 1)), (2, None)], "k int, BirthDate date")
    assert clean.plausible_age(df).count() == 2
    old = df.union(spark.createDataFrame([(3, dt.date(1850, 1, 1))], "k int, BirthDate date"))
    assert [r.k for r in clean.plausible_age(old).collect()] == [1]
    assert sorted(r.k for r in clean.plausible_age(old, strict=True).collect()) == [1, 2]


def test_trim_of_empty_table(spark):
    empty = spark.createDataFrame([], "v double")
    assert clean.trim_tails(empty, "v").count() == 0
    assert clean.trim_top(spark.createDataFrame([(None,), (1.0,)], "v double"), "v").select(F.sum("v")).first()[0] == 1.0
