"""Cleaning rules, table cleaners and data profiles over the untidy views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillwise.functions import dates, text
from tillwise.functions.numeric import ratio
from tillwise.operators import clean, customer, joins, ordering, pricing, profile
from tillwise.schemas import EXPECTED_WIDTH
from tillwise.session import shared_folder
from tillwise.sources import tables
from workloads.registry import PARTS, Tables, query

LAST = "1999-06-30"

# --- schema and reading ----------------------------------------------------


@query(
    "schema_report",
    """SELECT 'customers' AS table_name, 13 AS expected_columns, 13 AS found_columns, count(*) AS rows, true AS matches FROM raw_customers
       UNION ALL SELECT 'products', 11, 11, count(*), true FROM raw_products
       UNION ALL SELECT 'territories', 4, 4, count(*), true FROM raw_territories
       UNION ALL SELECT 'returns', 4, 3, count(*), false FROM returns""",
)
def _(t: Tables):
    tables = {
        "customers": t.raw_customers, "products": t.raw_products, "territories": t.raw_territories, "returns": t.returns,
    }
    return profile.schema_report(tables, EXPECTED_WIDTH)


@query("pruned_read", "SELECT ProductKey, CustomerKey FROM sales")
def _(t: Tables):
    folder = f"{shared_folder(t.spark)}/cleaned-sales-{uuid.uuid4().hex}"
    tables.write_cleaned(t.sales, folder)
    return tables.read_cleaned(t.spark, folder, ["ProductKey", "CustomerKey"])


# --- row rules -------------------------------------------------------------


@query(
    "keep_filled_rows",
    """SELECT CustomerKey, FirstName, LastName, Gender, Prefix FROM raw_customers
       WHERE (CASE WHEN FirstName IS NULL THEN 0 ELSE 1 END) + (CASE WHEN LastName IS NULL THEN 0 ELSE 1 END)
           + (CASE WHEN Gender IS NULL THEN 0 ELSE 1 END) + (CASE WHEN Prefix IS NULL THEN 0 ELSE 1 END)
           + (CASE WHEN CustomerKey IS NULL THEN 0 ELSE 1 END) >= 4""",
)
def _(t: Tables):
    return clean.keep_filled_rows(t.raw_customers.select("CustomerKey", "FirstName", "LastName", "Gender", "Prefix"), 0.8)


@query("drop_repeats", "SELECT DISTINCT OrderDate, ProductKey, OrderQuantity FROM sales")
def _(t: Tables):
    return clean.drop_repeats(t.sales.select("OrderDate", "ProductKey", "OrderQuantity"))


@query("require_all", "SELECT CustomerKey, FirstName, LastName FROM raw_customers WHERE FirstName IS NOT NULL AND LastName IS NOT NULL")
def _(t: Tables):
    return clean.require_all(t.raw_customers.select("CustomerKey", "FirstName", "LastName"), ["FirstName", "LastName"])


@query("require_any", "SELECT CustomerKey, FirstName, LastName FROM raw_customers WHERE FirstName IS NOT NULL OR LastName IS NOT NULL")
def _(t: Tables):
    return clean.require_any(t.raw_customers.select("CustomerKey", "FirstName", "LastName"), ["FirstName", "LastName"])


@query("strip_text", "SELECT ProductKey, trim(ProductName) AS ProductName, trim(ProductSize) AS ProductSize FROM raw_products")
def _(t: Tables):
    return clean.strip_text(t.raw_products.select("ProductKey", "ProductName", "ProductSize"))


@query("without_digits", "SELECT ProductSubcategoryKey, SubcategoryName FROM raw_subcategories WHERE SubcategoryName IS NOT NULL AND NOT regexp_matches(SubcategoryName, '[0-9]')")
def _(t: Tables):
    return clean.without_digits(t.raw_subcategories.select("ProductSubcategoryKey", "SubcategoryName"), "SubcategoryName")


@query("valid_emails", "SELECT CustomerKey, EmailAddress FROM raw_customers WHERE EmailAddress LIKE 'user%@shop.example'")
def _(t: Tables):
    return clean.valid_emails(t.raw_customers.select("CustomerKey", "EmailAddress"))


@query("alphabetic_names", "SELECT CustomerKey, FirstName, LastName FROM raw_customers WHERE regexp_full_match(FirstName, '[A-Za-z \\-]+') AND regexp_full_match(LastName, '[A-Za-z \\-]+')")
def _(t: Tables):
    return clean.alphabetic_names(t.raw_customers.select("CustomerKey", "FirstName", "LastName"))


@query(
    "plausible_age",
    """SELECT CustomerKey, CAST(BirthDate AS DATE) AS BirthDate FROM raw_customers
       WHERE date_diff('day', CAST(BirthDate AS DATE), DATE '2017-06-01') / 365.25 <= 100""",
)
def _(t: Tables):
    df = t.raw_customers.select("CustomerKey", F.try_to_date("BirthDate").alias("BirthDate"))
    return clean.plausible_age(df)


@query("within_domains", "SELECT CustomerKey, Occupation, MaritalStatus FROM raw_customers WHERE Occupation <> 'Pirate'")
def _(t: Tables):
    domains = {c: clean.CUSTOMER_DOMAINS[c] for c in ("Occupation", "MaritalStatus")}
    return clean.within_domains(t.raw_customers.select("CustomerKey", "Occupation", "MaritalStatus"), domains)


@query("at_most", "SELECT CustomerKey, TotalChildren FROM raw_customers WHERE TotalChildren <= 15")
def _(t: Tables):
    return clean.at_most(t.raw_customers.select("CustomerKey", "TotalChildren"), "TotalChildren", 15)


@query("date_guardrail", f"SELECT OrderDate, OrderNumber FROM sales WHERE OrderDate <= DATE '{LAST}'")
def _(t: Tables):
    return clean.until(t.sales.select("OrderDate", "OrderNumber"), "OrderDate", LAST)


@query("date_cutoff", "SELECT OrderDate, OrderNumber FROM sales WHERE OrderDate >= DATE '2000-01-01'")
def _(t: Tables):
    return clean.since(t.sales.select("OrderDate", "OrderNumber"), "OrderDate", "2000-01-01")


@query("trailing_year", "SELECT OrderDate, ProductKey, OrderQuantity FROM sales WHERE OrderDate >= (SELECT max(OrderDate) - 365 FROM sales)")
def _(t: Tables):
    return clean.trailing_days(t.sales.select("OrderDate", "ProductKey", "OrderQuantity"), "OrderDate")


PARTS["price_cut"] = """SELECT ProductKey, ProductPrice, ProductCost FROM products
    WHERE ProductPrice BETWEEN (SELECT quantile_cont(ProductPrice, 0.005) FROM products)
                           AND (SELECT quantile_cont(ProductPrice, 0.995) FROM products)"""


@query(
    "trim_both_tails",
    """SELECT * FROM price_cut WHERE ProductCost BETWEEN (SELECT quantile_cont(ProductCost, 0.005) FROM price_cut)
                                                 AND (SELECT quantile_cont(ProductCost, 0.995) FROM price_cut)""",
)
def _(t: Tables):
    df = t.products.select("ProductKey", "ProductPrice", "ProductCost")
    return clean.trim_tails(clean.trim_tails(df, "ProductPrice"), "ProductCost")


@query("trim_top", "SELECT OrderNumber, ProductKey, OrderQuantity FROM sales WHERE OrderQuantity <= (SELECT quantile_cont(OrderQuantity, 0.99) FROM sales)")
def _(t: Tables):
    return clean.trim_top(t.sales.select("OrderNumber", "ProductKey", "OrderQuantity"), "OrderQuantity")


@query(
    "currency_column",
    "SELECT CustomerKey, CAST(replace(replace(AnnualIncome, '$', ''), ',', '') AS DOUBLE) AS AnnualIncome FROM raw_customers WHERE AnnualIncome <> 'unknown'",
)
def _(t: Tables):
    return clean.currency_column(t.raw_customers.select("CustomerKey", "AnnualIncome"), "AnnualIncome")


@query("numeric_column", "SELECT ProductKey, TRY_CAST(ProductCost AS DOUBLE) AS ProductCost FROM raw_products")
def _(t: Tables):
    return clean.numeric_column(t.raw_products.select("ProductKey", "ProductCost"), "ProductCost")


PARTS["parsed_calendar"] = """SELECT coalesce(try_strptime("Date", '%Y-%m-%d'), try_strptime("Date", '%d-%m-%Y'), try_strptime("Date", '%d/%m/%Y'))::DATE AS "Date" FROM raw_calendar"""


@query("mixed_dates", 'SELECT "Date" FROM parsed_calendar')
def _(t: Tables):
    return clean.date_column(t.raw_calendar, "Date")


PARTS["gendered"] = """SELECT c.CustomerKey, c.MaritalStatus, c.Prefix,
        coalesce(c.Gender, CASE WHEN g.gender LIKE '%female%' THEN 'F' WHEN g.gender LIKE '%male%' THEN 'M' END) AS Gender
    FROM raw_customers c LEFT JOIN name_genders g ON c.FirstName = g.first_name"""
PARTS["prefixed"] = """SELECT CustomerKey, MaritalStatus, Gender, coalesce(Prefix, CASE WHEN Gender = 'M' THEN 'MR.'
        WHEN Gender = 'F' AND MaritalStatus = 'M' THEN 'MRS.' WHEN Gender = 'F' THEN 'MS.' END) AS Prefix FROM gendered"""


@query("impute_gender", "SELECT CustomerKey, coalesce(Gender, 'U') AS Gender FROM gendered")
def _(t: Tables):
    df = clean.impute_gender(t.raw_customers, t.name_genders)
    return clean.fill(df.select("CustomerKey", "Gender"), {"Gender": "U"})


@query(
    "impute_prefix",
    """SELECT CustomerKey, coalesce(Gender, 'U') AS Gender, coalesce(Prefix, (SELECT Prefix FROM prefixed
           WHERE Prefix IS NOT NULL GROUP BY Prefix ORDER BY count(*) DESC, Prefix LIMIT 1)) AS Prefix FROM prefixed""",
)
def _(t: Tables):
    df = clean.impute_gender(t.raw_customers, t.name_genders)
    return clean.impute_prefix(df).select("CustomerKey", "Gender", "Prefix")


@query(
    "impute_color",
    """SELECT ProductKey, coalesce(ProductColor,
              CASE WHEN lower(ProductName) LIKE '%silver/black%' THEN 'Silver/Black' WHEN lower(ProductName) LIKE '%red%' THEN 'Red'
                   WHEN lower(ProductName) LIKE '%black%' THEN 'Black' WHEN lower(ProductName) LIKE '%white%' THEN 'White'
                   WHEN lower(ProductName) LIKE '%blue%' THEN 'Blue' WHEN lower(ProductName) LIKE '%multi%' THEN 'Multi'
                   WHEN lower(ProductName) LIKE '%silver%' THEN 'Silver' WHEN lower(ProductName) LIKE '%yellow%' THEN 'Yellow'
                   WHEN lower(ProductName) LIKE '%grey%' THEN 'Grey' END,
              (SELECT ProductColor FROM raw_products WHERE ProductColor IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS ProductColor
       FROM raw_products""",
)
def _(t: Tables):
    return clean.impute_color(t.raw_products).select("ProductKey", "ProductColor")


@query(
    "constant_fills",
    """SELECT CustomerKey, coalesce(Gender, 'Unknown') AS Gender, coalesce(TotalChildren, 0) AS TotalChildren,
              coalesce(CAST(BirthDate AS DATE), (SELECT min(CAST(BirthDate AS DATE)) FROM raw_customers)) AS BirthDate FROM raw_customers""",
)
def _(t: Tables):
    df = t.raw_customers.select("CustomerKey", "Gender", "TotalChildren", F.try_to_date("BirthDate").alias("BirthDate"))
    earliest = df.agg(F.min("BirthDate")).scalar()
    return clean.fill(df, {"Gender": "Unknown", "TotalChildren": 0, "BirthDate": earliest})


@query(
    "derived_measures",
    """SELECT s.OrderNumber, s.OrderLineItem, s.ProductKey, s.OrderQuantity,
              round((p.ProductPrice - p.ProductCost) * s.OrderQuantity, 4) AS profit, round(p.ProductPrice * s.OrderQuantity, 4) AS revenue
       FROM sales s LEFT JOIN products p ON s.ProductKey = p.ProductKey""",
)
def _(t: Tables):
    df = t.sales.join(t.products, "ProductKey", "left")
    gain = (F.col("ProductPrice") - F.col("ProductCost")) * F.col("OrderQuantity")
    return df.select(
        "OrderNumber", "OrderLineItem", "ProductKey", "OrderQuantity", F.round(gain, 4).alias("profit"),
        F.round(F.col("ProductPrice") * F.col("OrderQuantity"), 4).alias("revenue"),
    )


@query("unit_cost", "SELECT CategoryName, event, OrderQuantity, ProductPrice - profit / OrderQuantity AS unit_cost FROM price_events")
def _(t: Tables):
    return t.price_events.select("CategoryName", "event", "OrderQuantity", pricing.unit_cost().alias("unit_cost"))


# --- table cleaners --------------------------------------------------------

PARTS["cust_a"] = """SELECT DISTINCT CustomerKey, trim(Prefix) AS Prefix, trim(FirstName) AS FirstName, trim(LastName) AS LastName,
        CAST(trim(BirthDate) AS DATE) AS BirthDate, trim(MaritalStatus) AS MaritalStatus, trim(Gender) AS Gender, trim(EmailAddress) AS EmailAddress,
        trim(AnnualIncome) AS AnnualIncome, TotalChildren, trim(EducationLevel) AS EducationLevel, trim(Occupation) AS Occupation, HomeOwner
    FROM raw_customers WHERE FirstName IS NOT NULL OR LastName IS NOT NULL"""
PARTS["cust_b"] = """SELECT * FROM cust_a WHERE NOT (SELECT coalesce(bool_or(date_diff('day', BirthDate, DATE '2017-06-01') / 365.25 > 100), false) FROM cust_a)
        OR date_diff('day', BirthDate, DATE '2017-06-01') / 365.25 <= 100"""
PARTS["cust_c"] = """SELECT b.* REPLACE (coalesce(b.Gender, CASE WHEN g.gender LIKE '%female%' THEN 'F' WHEN g.gender LIKE '%male%' THEN 'M' END) AS Gender)
    FROM cust_b b LEFT JOIN name_genders g ON b.FirstName = g.first_name"""
PARTS["cust_d"] = """SELECT * REPLACE (coalesce(Prefix, CASE WHEN Gender = 'M' THEN 'MR.' WHEN Gender = 'F' AND MaritalStatus = 'M' THEN 'MRS.'
        WHEN Gender = 'F' THEN 'MS.' END) AS Prefix) FROM cust_c"""
PARTS["cust_e"] = """SELECT * REPLACE (coalesce(Prefix, (SELECT Prefix FROM cust_d WHERE Prefix IS NOT NULL GROUP BY Prefix ORDER BY count(*) DESC, Prefix LIMIT 1)) AS Prefix,
        coalesce(Gender, 'U') AS Gender, TRY_CAST(replace(replace(AnnualIncome, '$', ''), ',', '') AS DOUBLE) AS AnnualIncome) FROM cust_d"""
PARTS["cust_f"] = """SELECT * FROM cust_e WHERE Prefix IN ('MR.', 'MS.', 'MRS.') AND MaritalStatus IN ('M', 'S') AND Gender IN ('M', 'F', 'U')
        AND EducationLevel IN ('Bachelors', 'Partial College', 'High School', 'Partial High School', 'Graduate Degree')
        AND Occupation IN ('Professional', 'Management', 'Skilled Manual', 'Clerical', 'Manual') AND HomeOwner IN ('Y', 'N')
        AND AnnualIncome IS NOT NULL AND EmailAddress LIKE '%_@_%._%' AND NOT regexp_matches(FirstName, '[^A-Za-z -]')
        AND NOT regexp_matches(LastName, '[^A-Za-z -]') AND TotalChildren <= 15"""


@query(
    "clean_customers",
    """SELECT * FROM cust_f WHERE AnnualIncome BETWEEN (SELECT quantile_cont(AnnualIncome, 0.005) FROM cust_f)
                                              AND (SELECT quantile_cont(AnnualIncome, 0.995) FROM cust_f)""",
)
def _(t: Tables):
    return clean.customers(t.raw_customers, t.name_genders)


PARTS["prod_a"] = """SELECT DISTINCT ProductKey, ProductSubcategoryKey, trim(ProductSKU) AS ProductSKU, trim(ProductName) AS ProductName,
        trim(ModelName) AS ModelName, ProductDescription, ProductColor, trim(ProductSize) AS ProductSize, ProductStyle, ProductCost, ProductPrice
    FROM raw_products WHERE ProductSubcategoryKey IS NOT NULL"""
PARTS["prod_b"] = """SELECT * REPLACE (coalesce(ProductColor, CASE WHEN lower(ProductName) LIKE '%silver/black%' THEN 'Silver/Black'
        WHEN lower(ProductName) LIKE '%red%' THEN 'Red' WHEN lower(ProductName) LIKE '%black%' THEN 'Black' WHEN lower(ProductName) LIKE '%white%' THEN 'White'
        WHEN lower(ProductName) LIKE '%blue%' THEN 'Blue' WHEN lower(ProductName) LIKE '%multi%' THEN 'Multi' WHEN lower(ProductName) LIKE '%silver%' THEN 'Silver'
        WHEN lower(ProductName) LIKE '%yellow%' THEN 'Yellow' WHEN lower(ProductName) LIKE '%grey%' THEN 'Grey' END,
        (SELECT ProductColor FROM prod_a WHERE ProductColor IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS ProductColor,
        TRY_CAST(ProductPrice AS DOUBLE) AS ProductPrice, TRY_CAST(ProductCost AS DOUBLE) AS ProductCost) FROM prod_a"""
PARTS["prod_c"] = """SELECT * FROM prod_b WHERE ProductPrice BETWEEN (SELECT quantile_cont(ProductPrice, 0.005) FROM prod_b)
        AND (SELECT quantile_cont(ProductPrice, 0.995) FROM prod_b)"""
PARTS["prod_d"] = """SELECT * FROM prod_c WHERE ProductCost BETWEEN (SELECT quantile_cont(ProductCost, 0.005) FROM prod_c)
        AND (SELECT quantile_cont(ProductCost, 0.995) FROM prod_c)"""


@query(
    "clean_products",
    """SELECT * FROM prod_d WHERE ProductColor IN ('Silver/Black', 'Red', 'Black', 'White', 'Blue', 'Multi', 'Silver', 'Yellow', 'Grey')
       AND ProductSize IN ('0', 'M', 'L', 'S', 'XL', '62', '44', '48', '52', '56', '58', '60', '42', '46', '38', '40', '70', '50', '54')
       AND ProductStyle IN ('0', 'U', 'W', 'M')""",
)
def _(t: Tables):
    return clean.products(t.raw_products)


@query("clean_calendar", f"""SELECT "Date" FROM parsed_calendar WHERE "Date" <= DATE '{LAST}' ORDER BY 1""")
def _(t: Tables):
    return clean.calendar(t.raw_calendar, LAST).orderBy("Date")


@query("clean_subcategories", "SELECT DISTINCT ProductSubcategoryKey, trim(SubcategoryName) AS SubcategoryName, ProductCategoryKey FROM raw_subcategories WHERE NOT regexp_matches(SubcategoryName, '[0-9]')")
def _(t: Tables):
    return clean.subcategories(t.raw_subcategories)


@query("clean_categories", "SELECT DISTINCT ProductCategoryKey, trim(CategoryName) AS CategoryName FROM raw_categories WHERE NOT regexp_matches(CategoryName, '[0-9]')")
def _(t: Tables):
    return clean.categories(t.raw_categories)


@query("clean_territories", "SELECT DISTINCT SalesTerritoryKey, trim(Region) AS Region, trim(Country) AS Country, Continent FROM raw_territories WHERE Region IS NOT NULL OR Country IS NOT NULL")
def _(t: Tables):
    return clean.territories(t.raw_territories)


PARTS["sale_a"] = f"""SELECT coalesce(try_strptime(OrderDate, '%Y-%m-%d'), try_strptime(OrderDate, '%d-%m-%Y'), try_strptime(OrderDate, '%d/%m/%Y'))::DATE AS OrderDate,
        CAST(StockDate AS DATE) AS StockDate, trim(OrderNumber) AS OrderNumber, ProductKey, CustomerKey, TerritoryKey, OrderLineItem, OrderQuantity
    FROM raw_sales"""
PARTS["sale_b"] = f"""SELECT OrderDate, OrderNumber, ProductKey, CustomerKey, TerritoryKey, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity,
        arg_min(StockDate, StockDate) AS StockDate, min(struct_pack(s := StockDate, l := OrderLineItem)).l AS OrderLineItem
    FROM sale_a WHERE OrderDate <= DATE '{LAST}' AND TerritoryKey IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""


@query("clean_sales", "SELECT * FROM sale_b WHERE OrderQuantity <= (SELECT quantile_cont(OrderQuantity, 0.99) FROM sale_b)")
def _(t: Tables):
    return clean.sales(t.raw_sales, LAST)


@query("merge_sale_lines", "SELECT OrderDate, OrderNumber, ProductKey, CustomerKey, TerritoryKey, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity, min(StockDate) AS StockDate FROM territory_sales GROUP BY 1, 2, 3, 4, 5")
def _(t: Tables):
    return clean.merge_sale_lines(t.territory_sales).drop("OrderLineItem")


PARTS["ret_a"] = "SELECT DISTINCT * FROM raw_returns WHERE ReturnQuantity IS NOT NULL AND ReturnDate IS NOT NULL AND ProductKey IS NOT NULL"


@query(
    "clean_returns",
    """SELECT * REPLACE (CAST(ReturnDate AS DATE) AS ReturnDate) FROM ret_a
       WHERE ReturnDate <> 'lost' AND ReturnQuantity <= (SELECT quantile_cont(ReturnQuantity, 0.99) FROM ret_a)""",
)
def _(t: Tables):
    return clean.returns(t.raw_returns)


PARTS["clean_prices"] = """SELECT CategoryName, CAST(ProductPrice AS DOUBLE) AS ProductPrice, CAST(OrderQuantity AS DOUBLE) AS OrderQuantity, profit, trim(event) AS event
    FROM (SELECT DISTINCT * FROM raw_price_events) t WHERE TRY_CAST(ProductPrice AS DOUBLE) IS NOT NULL"""


@query("clean_price_events", "SELECT * FROM clean_prices")
def _(t: Tables):
    return clean.price_events(t.raw_price_events)


@query("csv_dates", "SELECT strftime(OrderDate, '%d-%m-%Y') AS OrderDate, strftime(StockDate, '%d-%m-%Y') AS StockDate, OrderNumber FROM sales")
def _(t: Tables):
    return clean.as_csv_dates(t.sales.select("OrderDate", "StockDate", "OrderNumber"))


# --- profiles --------------------------------------------------------------


@query(
    "quality_profile",
    """SELECT u.column_name, u.nulls, u.rows, u.rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_returns) d) AS duplicates FROM (
         SELECT 'ReturnDate' AS column_name, count(*) - count(ReturnDate) AS nulls, count(*) AS rows FROM raw_returns
         UNION ALL SELECT 'TerritoryKey', count(*) - count(TerritoryKey), count(*) FROM raw_returns
         UNION ALL SELECT 'ProductKey', count(*) - count(ProductKey), count(*) FROM raw_returns
         UNION ALL SELECT 'ReturnQuantity', count(*) - count(ReturnQuantity), count(*) FROM raw_returns) u""",
)
def _(t: Tables):
    return profile.quality_profile(t.raw_returns)


@query("distinct_values", "SELECT DISTINCT Occupation FROM raw_customers")
def _(t: Tables):
    return profile.distinct_values(t.raw_customers, "Occupation")


@query(
    "calendar_gaps",
    """SELECT date_diff('day', min(OrderDate), max(OrderDate)) + 1 AS expected_days, count(DISTINCT OrderDate) AS actual_days,
              date_diff('day', min(OrderDate), max(OrderDate)) + 1 - count(DISTINCT OrderDate) AS missing_days FROM sales""",
)
def _(t: Tables):
    return profile.calendar_gaps(t.sales, "OrderDate")


@query(
    "describe",
    """SELECT 'OrderQuantity' AS column_name, count(OrderQuantity) AS count, round(avg(OrderQuantity), 6) AS mean, round(stddev_samp(OrderQuantity), 6) AS std,
              CAST(min(OrderQuantity) AS DOUBLE) AS min, quantile_cont(OrderQuantity, 0.25) AS q25, quantile_cont(OrderQuantity, 0.5) AS q50,
              quantile_cont(OrderQuantity, 0.75) AS q75, CAST(max(OrderQuantity) AS DOUBLE) AS max FROM sales
       UNION ALL SELECT 'OrderLineItem', count(OrderLineItem), round(avg(OrderLineItem), 6), round(stddev_samp(OrderLineItem), 6), min(OrderLineItem),
              quantile_cont(OrderLineItem, 0.25), quantile_cont(OrderLineItem, 0.5), quantile_cont(OrderLineItem, 0.75), max(OrderLineItem) FROM sales""",
)
def _(t: Tables):
    df = profile.describe(t.sales, ["OrderQuantity", "OrderLineItem"])
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "exact_quantiles_by_key",
    """SELECT CategoryName, event, round(quantile_cont(profit, 0.1), 7) AS low, round(quantile_cont(profit, 0.5), 7) AS mid, round(quantile_cont(profit, 0.9), 7) AS high
       FROM price_events GROUP BY 1, 2""",
)
def _(t: Tables):
    q = ordering.quantiles(t.price_events, "profit", [0.1, 0.5, 0.9], ["CategoryName", "event"], ["low", "mid", "high"])
    return q.withColumns({c: F.round(c, 7) for c in ("low", "mid", "high")})


@query("orphan_keys", "SELECT ProductKey, count(*) AS affected_rows FROM sales WHERE ProductKey NOT IN (SELECT ProductKey FROM products) GROUP BY 1")
def _(t: Tables):
    return profile.orphan_keys(t.sales, t.products, "ProductKey")


@query(
    "missing_from_calendar",
    'SELECT OrderDate AS "Date", count(*) AS rows FROM sales WHERE OrderDate NOT IN (SELECT "Date" FROM parsed_calendar WHERE "Date" IS NOT NULL) GROUP BY 1',
)
def _(t: Tables):
    return profile.missing_from_calendar(t.sales, clean.calendar(t.raw_calendar, "2099-12-31"), "OrderDate")


# --- scalar functions ------------------------------------------------------


@query(
    "calendar_parts",
    """SELECT OrderNumber, OrderLineItem, OrderDate, month(OrderDate) AS month, isodow(OrderDate) - 1 AS dow, dayofyear(OrderDate) AS doy, year(OrderDate) AS year,
              strftime(OrderDate, '%a') AS day_label, (day(OrderDate) - 1) // 7 + 1 AS week_of_month, isodow(OrderDate) >= 6 AS weekend,
              day(OrderDate) IN (15, 30) AS payday, CAST(date_trunc('week', OrderDate) AS DATE) AS week, CAST(OrderDate + INTERVAL 3 MONTH AS DATE) AS later
       FROM sales""",
)
def _(t: Tables):
    d = F.col("OrderDate")
    return t.sales.select(
        "OrderNumber", "OrderLineItem", "OrderDate", F.month(d).alias("month"), F.weekday(d).alias("dow"), F.dayofyear(d).alias("doy"), F.year(d).alias("year"),
        dates.weekday_label(d).alias("day_label"), dates.week_of_month(d).alias("week_of_month"), dates.is_weekend(d).alias("weekend"),
        dates.is_payday(d).alias("payday"), F.trunc(d, "week").alias("week"), F.add_months(d, 3).alias("later"),
    )


@query(
    "federal_holidays",
    """SELECT DISTINCT OrderDate FROM sales, (SELECT 1) one WHERE
        (month(OrderDate) = 1 AND isodow(OrderDate) = 1 AND day(OrderDate) BETWEEN 15 AND 21)
        OR (month(OrderDate) = 2 AND isodow(OrderDate) = 1 AND day(OrderDate) BETWEEN 15 AND 21)
        OR (month(OrderDate) = 5 AND isodow(OrderDate) = 1 AND day(OrderDate) >= 25)
        OR (month(OrderDate) = 9 AND isodow(OrderDate) = 1 AND day(OrderDate) <= 7)
        OR (month(OrderDate) = 10 AND isodow(OrderDate) = 1 AND day(OrderDate) BETWEEN 8 AND 14)
        OR (month(OrderDate) = 11 AND isodow(OrderDate) = 4 AND day(OrderDate) BETWEEN 22 AND 28)
        OR EXISTS (SELECT 1 FROM (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) f(m, d), (VALUES (-1), (0), (1)) y(off)
                   WHERE OrderDate = (CASE isodow(make_date(year(OrderDate) + off, m, d)) WHEN 6 THEN make_date(year(OrderDate) + off, m, d) - 1
                                      WHEN 7 THEN make_date(year(OrderDate) + off, m, d) + 1 ELSE make_date(year(OrderDate) + off, m, d) END))""",
)
def _(t: Tables):
    return t.sales.filter(dates.is_us_federal_holiday(F.col("OrderDate"))).select("OrderDate").distinct()


@query(
    "text_functions",
    """SELECT ProductKey, lower(trim(ProductName)) AS lowered, contains(ProductName, 'ring') AS has_ring, regexp_matches(ProductSKU, '[0-9]') AS digits,
              substr(trim(ProductName), 1, 3) AS label, CAST(ProductKey AS VARCHAR) || '%' AS percent_label FROM raw_products""",
)
def _(t: Tables):
    name = text.strip(F.col("ProductName"))
    return t.raw_products.select(
        "ProductKey", F.lower(name).alias("lowered"), F.col("ProductName").contains("ring").alias("has_ring"),
        text.has_digit(F.col("ProductSKU")).alias("digits"), F.substring(name, 1, 3).alias("label"),
        F.concat(F.col("ProductKey").cast("string"), F.lit("%")).alias("percent_label"),
    )


@query(
    "math_functions",
    """SELECT OrderNumber, OrderLineItem, round(ln(1 + OrderQuantity), 6) AS log_qty, round(sin(2 * pi() * month(OrderDate) / 12), 6) AS month_sin,
              round(cos(2 * pi() * month(OrderDate) / 12), 6) AS month_cos, greatest(10, least(40, OrderQuantity)) AS clipped, round(sqrt(OrderQuantity), 6) AS root
       FROM sales""",
)
def _(t: Tables):
    s, c = dates.cyclical(F.month("OrderDate"), 12)
    q = F.col("OrderQuantity")
    return t.sales.select(
        "OrderNumber", "OrderLineItem", F.round(F.log1p(q), 6).alias("log_qty"), (F.round(s, 6) + 0.0).alias("month_sin"), (F.round(c, 6) + 0.0).alias("month_cos"),
        F.greatest(F.lit(10), F.least(F.lit(40), q)).alias("clipped"), F.round(F.sqrt(q), 6).alias("root"),
    )


@query("customer_age", "SELECT CustomerKey, CAST(floor(date_diff('day', CAST(BirthDate AS DATE), DATE '2017-08-01') / 365.0) AS INT) AS Age FROM raw_customers")
def _(t: Tables):
    df = t.raw_customers.withColumn("BirthDate", F.try_to_date("BirthDate"))
    return customer.demographics(df).select("CustomerKey", "Age")


@query(
    "top_groups",
    "SELECT ProductKey, CAST(sum(OrderQuantity) AS BIGINT) AS total FROM sales GROUP BY 1 ORDER BY total DESC, ProductKey LIMIT 10",
)
def _(t: Tables):
    return ordering.top_groups(t.sales, "ProductKey", "OrderQuantity", 10)


@query(
    "sales_with_items",
    """SELECT s.OrderNumber, s.OrderLineItem, s.ProductKey, s.OrderQuantity, c.SubcategoryName FROM sales s LEFT JOIN products p ON s.ProductKey = p.ProductKey
       LEFT JOIN subcategories c ON p.ProductSubcategoryKey = c.ProductSubcategoryKey""",
)
def _(t: Tables):
    return joins.enrich_sales(t.sales, t.products, t.subcategories).select("OrderNumber", "OrderLineItem", "ProductKey", "OrderQuantity", "SubcategoryName")


@query(
    "territory_lookup",
    """SELECT s.TerritoryKey, coalesce(t.Country, 'Unknown') AS Country, coalesce(t.Continent, 'Unknown') AS Continent, count(*) AS lines
       FROM territory_sales s LEFT JOIN territories t ON s.TerritoryKey = t.SalesTerritoryKey GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    counted = t.territory_sales.groupBy("TerritoryKey").agg(F.count(F.lit(1)).alias("lines"))
    table = t.territories.withColumnRenamed("SalesTerritoryKey", "TerritoryKey")
    return joins.look_up(counted, table, ["TerritoryKey"], {"Country": F.lit("Unknown"), "Continent": F.lit("Unknown")})


@query(
    "key_set_operations",
    """SELECT 'union' AS op, count(*) AS keys FROM (SELECT ProductKey FROM sales UNION SELECT ProductKey FROM products)
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT ProductKey FROM sales INTERSECT SELECT ProductKey FROM products)
       UNION ALL SELECT 'difference', count(*) FROM (SELECT ProductKey FROM sales EXCEPT SELECT ProductKey FROM products)""",
)
def _(t: Tables):
    a, b = t.sales.select("ProductKey"), t.products.select("ProductKey")
    out = None
    for op in ("union", "intersect", "difference"):
        row = joins.key_set(a, b, op).agg(F.count(F.lit(1)).alias("keys")).select(F.lit(op).alias("op"), "keys")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "percentage_share",
    "SELECT event, round(100.0 * count(*) / (SELECT count(*) FROM price_events), 6) AS share FROM price_events GROUP BY 1",
)
def _(t: Tables):
    total = t.price_events.agg(F.count(F.lit(1))).scalar()
    rows = t.price_events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event", F.round(ratio(F.col("n"), total) * 100, 6).alias("share"))
