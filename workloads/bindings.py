"""Driver tables seen as retail tables.

Each view is one SELECT that Spark and the SQL oracle both run; it only maps
columns, so the operators under test stay independent of their oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")

# View name -> SELECT over driver tables or earlier views.
VIEWS: dict[str, str] = {
    "sales": """
        SELECT CAST(o.o_orderdate AS DATE) AS OrderDate,
               CAST(least(l.l_shipdate, o.o_orderdate) AS DATE) AS StockDate,
               'SO' || CAST(l.l_orderkey AS VARCHAR(20)) AS OrderNumber,
               l.l_partkey AS ProductKey, o.o_custkey AS CustomerKey,
               l.l_linenumber AS OrderLineItem, CAST(l.l_quantity AS INT) AS OrderQuantity
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "territory_sales": """
        SELECT s.*, c.c_nationkey AS TerritoryKey
        FROM sales s JOIN customer c ON s.CustomerKey = c.c_custkey""",
    "products": """
        SELECT p_partkey AS ProductKey, p_name AS ProductName,
               CAST(substr(p_brand, 7) AS INT) AS ProductSubcategoryKey,
               p_retailprice AS ProductPrice,
               floor(p_retailprice * (40 + 10 * (p_partkey % 5))) / CAST(100 AS DOUBLE) AS ProductCost,
               CAST(p_size AS VARCHAR(10)) AS ProductSize, p_type AS CategoryName
        FROM part WHERE p_partkey % 97 <> 0""",
    "subcategories": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS ProductSubcategoryKey,
               p_brand AS SubcategoryName,
               CAST(substr(p_brand, 7) AS INT) % 5 AS ProductCategoryKey
        FROM part""",
    "word_items": """
        SELECT p_partkey AS ProductKey, p_name AS SubcategoryName
        FROM part WHERE p_partkey % 97 <> 0""",
    "territories": """
        SELECT n_nationkey AS SalesTerritoryKey, n_name AS Country, r_name AS Continent
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "returns": """
        SELECT CAST(l_shipdate AS DATE) AS ReturnDate, l_partkey AS ProductKey,
               CAST(l_quantity AS INT) AS ReturnQuantity
        FROM lineitem WHERE l_returnflag = 'R'""",
    "weekly_spend": """
        SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'tv_s' WHEN '2-HIGH' THEN 'ooh_s'
                    WHEN '3-MEDIUM' THEN 'print_s' WHEN '4-NOT SPECIFIED' THEN 'facebook_s'
                    ELSE 'search_s' END AS channel,
               sum(o_totalprice) AS spend
        FROM orders GROUP BY 1, 2""",
    "weekly_profit": """
        SELECT CAST(date_trunc('week', o.o_orderdate) AS DATE) AS date,
               sum(l.l_extendedprice * (1 - l.l_discount)) AS profit
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1""",
    "market_spend": """
        SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, c_nationkey AS market,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'tv_s' WHEN '2-HIGH' THEN 'ooh_s'
                    WHEN '3-MEDIUM' THEN 'print_s' WHEN '4-NOT SPECIFIED' THEN 'facebook_s'
                    ELSE 'search_s' END AS channel,
               sum(o_totalprice) AS spend
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "price_events": """
        SELECT p_type AS CategoryName, floor(l_extendedprice / l_quantity * 100) / CAST(100 AS DOUBLE) AS ProductPrice,
               l_quantity AS OrderQuantity,
               l_extendedprice * (1 - l_discount)
                 - floor(p_retailprice * (40 + 10 * (p_partkey % 5))) / CAST(100 AS DOUBLE) * l_quantity AS profit,
               CASE WHEN l_discount < 0.025 THEN 'No Promo' WHEN l_discount < 0.055 THEN 'Back to School'
                    WHEN l_discount < 0.085 THEN 'Cyber Monday' ELSE 'Black Friday' END AS event
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Raw, deliberately untidy versions of the tables for the cleaners.
    "raw_customers": """
        SELECT c_custkey AS CustomerKey,
               CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN ' MR. ' WHEN 2 THEN 'MRS.' WHEN 3 THEN 'DR.'
                    ELSE 'MS.' END AS Prefix,
               CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN c_name
                    WHEN c_custkey % 3 = 0 THEN '  Ann ' WHEN c_custkey % 3 = 1 THEN 'John' ELSE 'Robin' END AS FirstName,
               CASE WHEN c_custkey % 58 = 0 THEN NULL ELSE c_mktsegment END AS LastName,
               CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN '1890-03-01'
                    ELSE CAST(1940 + c_custkey % 55 AS VARCHAR(4)) || '-0' || CAST(1 + c_custkey % 9 AS VARCHAR(1)) || '-15' END AS BirthDate,
               CASE c_custkey % 2 WHEN 0 THEN 'M' ELSE 'S' END AS MaritalStatus,
               CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'M' WHEN 2 THEN 'M' WHEN 3 THEN 'M' ELSE 'F' END AS Gender,
               CASE WHEN c_custkey % 37 = 0 THEN 'not-an-address' WHEN c_custkey % 43 = 0 THEN NULL
                    ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@shop.example' END AS EmailAddress,
               CASE WHEN c_custkey % 53 = 0 THEN 'unknown'
                    ELSE '$' || CAST(CAST(floor(abs(c_acctbal) / 1000) AS INT) AS VARCHAR(10)) || ',' || CAST(100 + c_custkey % 900 AS VARCHAR(3)) END AS AnnualIncome,
               CAST(c_custkey % 17 AS INT) AS TotalChildren,
               CASE c_custkey % 6 WHEN 0 THEN 'Bachelors' WHEN 1 THEN 'Partial College' WHEN 2 THEN 'High School '
                    WHEN 3 THEN 'Partial High School' WHEN 4 THEN 'Graduate Degree' ELSE 'Bachelors' END AS EducationLevel,
               CASE WHEN c_custkey % 61 = 0 THEN 'Pirate' WHEN c_custkey % 5 = 0 THEN 'Professional' WHEN c_custkey % 5 = 1 THEN 'Management'
                    WHEN c_custkey % 5 = 2 THEN 'Skilled Manual' WHEN c_custkey % 5 = 3 THEN 'Clerical' ELSE 'Manual' END AS Occupation,
               CASE c_nationkey % 2 WHEN 0 THEN 'Y' ELSE 'N' END AS HomeOwner
        FROM customer""",
    "name_genders": """
        SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'John' ELSE 'Ann' END AS first_name,
               CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'mostly_female' END AS gender
        FROM customer""",
    "raw_products": """
        SELECT p_partkey AS ProductKey,
               CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE CAST(substr(p_brand, 7) AS INT) END AS ProductSubcategoryKey,
               p_brand AS ProductSKU, '  ' || p_name || ' ' AS ProductName, p_type AS ModelName,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS ProductDescription,
               CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'Purple' WHEN p_partkey % 2 = 0 THEN 'Silver' ELSE 'Black' END AS ProductColor,
               CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR(3)) WHEN p_size > 20 THEN 'M' ELSE ' L' END AS ProductSize,
               CASE WHEN p_partkey % 5 = 0 THEN 'U' WHEN p_partkey % 5 = 1 THEN 'W' WHEN p_partkey % 67 = 2 THEN 'X' ELSE '0' END AS ProductStyle,
               CASE WHEN p_partkey % 71 = 0 THEN 'n.v.' ELSE CAST(floor(p_retailprice * (40 + 10 * (p_partkey % 5))) / CAST(100 AS DOUBLE) AS VARCHAR(20)) END AS ProductCost,
               CAST(p_retailprice AS VARCHAR(20)) AS ProductPrice
        FROM part""",
    "raw_calendar": """
        SELECT CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no date'
                    WHEN 2 THEN substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4)
                    WHEN 3 THEN substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4)
                    ELSE d END AS "Date"
        FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS d FROM orders) t""",
    "raw_subcategories": """
        SELECT DISTINCT CAST(p_size AS INT) AS ProductSubcategoryKey,
               CASE WHEN p_partkey % 7 = 0 THEN p_brand WHEN p_partkey % 11 = 0 THEN NULL ELSE '  ' || p_name || ' ' END AS SubcategoryName,
               CAST(p_size % 5 AS INT) AS ProductCategoryKey
        FROM part""",
    "raw_categories": """
        SELECT DISTINCT CAST(p_size AS INT) AS ProductCategoryKey,
               CASE WHEN p_partkey % 7 = 0 THEN p_brand WHEN p_partkey % 11 = 0 THEN NULL ELSE ' ' || p_type END AS CategoryName
        FROM part""",
    "raw_territories": """
        SELECT c_nationkey AS SalesTerritoryKey,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ' ' || c_mktsegment || ' ' END AS Region,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name || '  ' END AS Country,
               r_name AS Continent
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_sales": """
        SELECT CASE ProductKey % 5 WHEN 0 THEN substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4)
                    WHEN 1 THEN substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4) ELSE d END AS OrderDate,
               CAST(StockDate AS VARCHAR(10)) AS StockDate,
               CASE WHEN OrderLineItem % 2 = 0 THEN ' ' || OrderNumber ELSE OrderNumber || '  ' END AS OrderNumber,
               ProductKey % 50 AS ProductKey, CustomerKey,
               CASE WHEN TerritoryKey = 7 THEN NULL ELSE TerritoryKey END AS TerritoryKey,
               OrderLineItem, OrderQuantity
        FROM (SELECT t.*, CAST(OrderDate AS VARCHAR(10)) AS d FROM territory_sales t) t""",
    "raw_returns": """
        SELECT CASE WHEN l_partkey % 13 = 0 THEN 'lost' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) END AS ReturnDate,
               CAST(l_suppkey % 10 AS INT) AS TerritoryKey, l_partkey % 100 AS ProductKey,
               CASE WHEN l_linenumber = 7 AND l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS ReturnQuantity
        FROM lineitem WHERE l_returnflag = 'R'""",
    "raw_price_events": """
        SELECT p_type AS CategoryName,
               CASE WHEN l_orderkey % 101 = 0 THEN 'call us' WHEN l_orderkey % 103 = 0 THEN NULL
                    ELSE CAST(floor(l_extendedprice / l_quantity * 100) / CAST(100 AS DOUBLE) AS VARCHAR(20)) END AS ProductPrice,
               CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS OrderQuantity,
               floor(l_extendedprice * (1 - l_discount) * 100) / CAST(100 AS DOUBLE) AS profit,
               CASE WHEN l_discount < 0.025 THEN ' No Promo' ELSE 'Black Friday ' END AS event
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

_WORD = re.compile(r"[A-Za-z_]+")


def _uses(sql: str, names) -> list[str]:
    words = set(_WORD.findall(re.sub(r"'[^']*'", "", sql)))
    return [n for n in names if n in words]


def view_closure(sql: str) -> list[str]:
    """Views a statement needs, in definition order."""
    wanted: set[str] = set()
    todo = _uses(sql, VIEWS)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [v for v in _uses(VIEWS[name], VIEWS) if v != name]
    return [v for v in VIEWS if v in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view as a DataFrame; every referenced table is passed by argument."""
    sql = VIEWS[name].replace('"Date"', "`Date`")
    inputs: dict[str, DataFrame] = {}
    for dep in _uses(sql, VIEWS):
        if dep != name and re.search(rf"\b(FROM|JOIN)\s+{dep}\b", sql):
            inputs[dep] = view(spark, sf_dir, dep)
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{table}\b", sql):
            inputs[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for dep in inputs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{dep}\b", rf"\1 {{{dep}}}", sql)
    return spark.sql(sql, **inputs)
