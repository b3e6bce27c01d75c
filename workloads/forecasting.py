"""Panels, routing, forecasts and the inventory tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.operators import clean, encoding, evaluate, forecast, inventory, joins, ordering, panel as panels, profile, routing
from tillwise.plans import demand
from tillwise.session import cut_lineage, staged
from workloads.registry import PARTS, Tables, query, solved

ITEM = "SubcategoryName"

# --- bound inputs: A = brand items, B = word items -------------------------


def items_a(t: Tables) -> DataFrame:
    return joins.product_items(t.products, t.subcategories)


def daily_a(t: Tables) -> DataFrame:
    return joins.daily_by_item(t.sales, items_a(t), "OrderDate", ["OrderQuantity"], ["StockDate"])


def panel_a(t: Tables) -> DataFrame:
    return panels.sales_panel(daily_a(t), t.subcategories)


def daily_b(t: Tables) -> DataFrame:
    return joins.daily_by_item(t.sales, t.word_items, "OrderDate", ["OrderQuantity"], ["StockDate"])


def written(df: DataFrame) -> DataFrame:
    """Panels that several steps of one query read are written once."""
    return cut_lineage(df)


def panel_b(t: Tables) -> DataFrame:
    return panels.sales_panel(daily_b(t), t.word_items)


def returns_gather(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    """``sold`` may supply the daily sales that a query has already."""
    if sold is None:
        sold = joins.daily_by_item(t.sales, items_a(t), "OrderDate", ["OrderQuantity"])
    back = joins.daily_by_item(t.returns, items_a(t), "ReturnDate", ["ReturnQuantity"])
    return panels.returns_gather(sold, back)


def returns_panel(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    return panels.returns_panel(returns_gather(t, sold), t.subcategories)


PARTS["pitems"] = "SELECT p.ProductKey, c.SubcategoryName FROM products p LEFT JOIN subcategories c ON p.ProductSubcategoryKey = c.ProductSubcategoryKey"
PARTS["year_lines"] = "SELECT * FROM sales"
PARTS["dly"] = """SELECT OrderDate, SubcategoryName, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity, min(StockDate) AS StockDate
    FROM year_lines JOIN pitems USING (ProductKey) GROUP BY 1, 2"""
PARTS["dlyb"] = """SELECT OrderDate, SubcategoryName, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity, min(StockDate) AS StockDate
    FROM year_lines JOIN word_items USING (ProductKey) GROUP BY 1, 2"""
for _d, _p, _m in (("dly", "pnl", "subcategories"), ("dlyb", "pnlb", "word_items")):
    PARTS[_p] = f"""SELECT g.OrderDate, i.SubcategoryName, CAST(coalesce(d.OrderQuantity, 0) AS INT) AS OrderQuantity,
            coalesce(d.StockDate, (SELECT min(StockDate) FROM {_d})) AS StockDate
        FROM (SELECT CAST(unnest(generate_series(min(OrderDate), max(OrderDate), INTERVAL 1 DAY)) AS DATE) AS OrderDate FROM {_d}) g
        CROSS JOIN (SELECT DISTINCT SubcategoryName FROM {_m}) i
        LEFT JOIN {_d} d ON d.OrderDate = g.OrderDate AND d.SubcategoryName = i.SubcategoryName"""
PARTS["rsold"] = "SELECT OrderDate, SubcategoryName, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity FROM sales JOIN pitems USING (ProductKey) GROUP BY 1, 2"
PARTS["rback"] = "SELECT ReturnDate, SubcategoryName, CAST(sum(ReturnQuantity) AS BIGINT) AS ReturnQuantity FROM returns JOIN pitems USING (ProductKey) GROUP BY 1, 2"
PARTS["rgath"] = """SELECT b.ReturnDate, coalesce(b.ReturnQuantity, 0) AS ReturnQuantity, s.SubcategoryName, s.OrderDate, s.OrderQuantity
    FROM rsold s LEFT JOIN rback b ON s.OrderDate = b.ReturnDate AND s.SubcategoryName = b.SubcategoryName"""
PARTS["rpnl"] = """SELECT g.ReturnDate, i.SubcategoryName, CAST(coalesce(r.ReturnQuantity, 0) AS INT) AS ReturnQuantity,
        CAST(coalesce(r.OrderQuantity, 0) AS INT) AS OrderQuantity, g.ReturnDate AS OrderDate
    FROM (SELECT CAST(unnest(generate_series(min(ReturnDate), max(ReturnDate), INTERVAL 1 DAY)) AS DATE) AS ReturnDate FROM rgath) g
    CROSS JOIN (SELECT DISTINCT SubcategoryName FROM subcategories) i
    LEFT JOIN (SELECT * FROM rgath WHERE ReturnDate IS NOT NULL) r ON r.ReturnDate = g.ReturnDate AND r.SubcategoryName = i.SubcategoryName"""

# --- aggregates and panels -------------------------------------------------


@query("daily_demand", "SELECT * FROM dly")
def _(t: Tables):
    return daily_a(t)


@query("daily_returns", "SELECT * FROM rback")
def _(t: Tables):
    return joins.daily_by_item(t.returns, items_a(t), "ReturnDate", ["ReturnQuantity"])


@query("product_items", "SELECT * FROM pitems")
def _(t: Tables):
    return items_a(t)


@query("earliest_stock", "SELECT min(StockDate) AS min_stock FROM sales WHERE OrderDate >= DATE '2000-01-01'")
def _(t: Tables):
    return clean.since(t.sales, "OrderDate", "2000-01-01").agg(F.min("StockDate").alias("min_stock"))


@query("sales_panel", "SELECT * FROM pnl")
def _(t: Tables):
    return panel_a(t)


@query("sales_panel_observed_items", "SELECT p.* FROM pnlb p WHERE SubcategoryName IN (SELECT SubcategoryName FROM dlyb)")
def _(t: Tables):
    return panels.sales_panel(daily_b(t))


@query(
    "sparse_panel",
    """SELECT OrderDate, SubcategoryName, CAST(sum(OrderQuantity) AS BIGINT) AS OrderQuantity, min(StockDate) AS StockDate FROM (
         SELECT * FROM dlyb UNION ALL SELECT m, SubcategoryName, 0, m FROM (SELECT DISTINCT SubcategoryName FROM word_items) i, (SELECT min(StockDate) AS m FROM dlyb) d) u
       WHERE OrderDate >= DATE '2000-06-01' GROUP BY 1, 2""",
)
def _(t: Tables):
    return panels.sparse_panel(daily_b(t), t.word_items, "2000-06-01")


@query("returns_gather", "SELECT * FROM rgath")
def _(t: Tables):
    return returns_gather(t)


@query(
    "returns_gather_full_outer",
    """SELECT coalesce(b.ReturnDate, s.OrderDate) AS ReturnDate, coalesce(b.ReturnQuantity, 0) AS ReturnQuantity, coalesce(s.SubcategoryName, b.SubcategoryName) AS SubcategoryName,
              coalesce(b.ReturnDate, s.OrderDate) AS OrderDate, coalesce(s.OrderQuantity, 0) AS OrderQuantity
       FROM rsold s FULL JOIN rback b ON s.OrderDate = b.ReturnDate AND s.SubcategoryName = b.SubcategoryName""",
)
def _(t: Tables):
    sold = joins.daily_by_item(t.sales, items_a(t), "OrderDate", ["OrderQuantity"])
    back = joins.daily_by_item(t.returns, items_a(t), "ReturnDate", ["ReturnQuantity"])
    return panels.returns_gather(sold, back, full_outer=True)


@query("returns_panel", "SELECT * FROM rpnl")
def _(t: Tables):
    return returns_panel(t)


# --- routing ---------------------------------------------------------------

_METRICS = """SELECT SubcategoryName, CAST(sum({v}) AS BIGINT) AS Total, count(*) FILTER (WHERE {v} = 0) AS ZeroDays, count(*) AS TotalDays,
    max({v}) AS MaxSingleDay, min({f}) AS FirstDate, max({d}) AS LastDate, round(count(*) FILTER (WHERE {v} = 0) / count(*), 6) AS ZeroRatio,
    round(sum({v}) / (date_diff('day', min({f}), max({d})) + 1), 6) AS DailyVelocity FROM {p} GROUP BY 1"""
PARTS["met"] = _METRICS.format(v="OrderQuantity", f="StockDate", d="OrderDate", p="pnl")
PARTS["metb"] = _METRICS.format(v="OrderQuantity", f="StockDate", d="OrderDate", p="pnlb")
PARTS["metr"] = _METRICS.format(v="ReturnQuantity", f="ReturnDate", d="ReturnDate", p="rpnl")


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("ZeroRatio", "DailyVelocity")})


@query("routing_metrics", "SELECT * FROM met")
def _(t: Tables):
    return _round_metrics(routing.metrics(panel_a(t)))


_SALES_ROUTE = "CASE WHEN MaxSingleDay / Total > 0.5 OR ZeroDays / TotalDays > 0.60 OR Total = 0 THEN 'ColdStart' WHEN ZeroDays / TotalDays <= 0.35 THEN 'AutoARIMA' ELSE 'Prophet' END"


@query("route_sales", f"SELECT SubcategoryName, {_SALES_ROUTE} AS TargetModel FROM met UNION ALL SELECT SubcategoryName, {_SALES_ROUTE} FROM metb")
def _(t: Tables):
    a = routing.route(routing.metrics(panel_a(t)), routing.SALES_POLICY).select(ITEM, "TargetModel")
    b = routing.route(routing.metrics(panel_b(t)), routing.SALES_POLICY).select(ITEM, "TargetModel")
    return a.unionByName(b)


@query(
    "route_returns",
    """SELECT SubcategoryName, CASE WHEN Total = 0 OR MaxSingleDay / Total > 0.70 OR ZeroDays / TotalDays > 0.85 THEN 'ColdStart'
              WHEN ZeroDays / TotalDays <= 0.40 THEN 'AutoARIMA' ELSE 'Prophet' END AS TargetModel FROM metr""",
)
def _(t: Tables):
    m = routing.metrics(returns_panel(t), "ReturnQuantity", "ReturnDate", None)
    return routing.route(m, routing.RETURNS_POLICY).select(ITEM, "TargetModel")


@query(
    "route_returns_notebook",
    "SELECT SubcategoryName, CASE WHEN ZeroDays / TotalDays > 0.60 THEN 'ColdStart' WHEN ZeroDays / TotalDays <= 0.35 THEN 'AutoARIMA' ELSE 'Prophet' END AS TargetModel FROM metr",
)
def _(t: Tables):
    m = routing.metrics(returns_panel(t), "ReturnQuantity", "ReturnDate", None)
    return routing.route(m, routing.RETURNS_NOTEBOOK_POLICY).select(ITEM, "TargetModel")


_VEL = "Total / (date_diff('day', FirstDate, LastDate) + 1)"


@query(
    "route_by_velocity",
    f"""SELECT SubcategoryName, CASE WHEN {_VEL} >= (SELECT quantile_cont({_VEL}, 0.99) FROM metb) OR ZeroDays / TotalDays < 0.20 THEN 'AutoARIMA'
              WHEN ZeroDays / TotalDays < 0.60 THEN 'Prophet' ELSE 'ColdStart' END AS TargetModel FROM metb""",
)
def _(t: Tables):
    return routing.route(routing.metrics(panel_b(t)), routing.VELOCITY_POLICY).select(ITEM, "TargetModel")


@query(
    "route_to_sequence_models",
    f"""SELECT SubcategoryName, CASE WHEN {_VEL} > (SELECT quantile_cont({_VEL}, 0.99) FROM met) OR ZeroDays / TotalDays < 0.10 THEN 'LSTM'
              WHEN ZeroDays / TotalDays < 0.50 THEN 'XGBOOST' ELSE 'COLD_START' END AS by_velocity,
              CASE WHEN ZeroDays / TotalDays < 0.10 THEN 'LSTM' WHEN ZeroDays / TotalDays < 0.50 THEN 'XGBOOST' ELSE 'COLD_START' END AS by_ratio FROM met""",
)
def _(t: Tables):
    m = routing.metrics(panel_a(t))
    both = routing.route(routing.route(m, routing.SEQUENCE_STRICT_POLICY, "by_velocity"), routing.RATIO_ONLY_POLICY, "by_ratio")
    return both.select(ITEM, "by_velocity", "by_ratio")


@query("route_counts", f"SELECT TargetModel, count(*) AS items FROM (SELECT {_SALES_ROUTE} AS TargetModel FROM metb) r GROUP BY 1")
def _(t: Tables):
    return routing.route_counts(routing.route(routing.metrics(panel_b(t)), routing.SALES_POLICY))


# --- encoding --------------------------------------------------------------

PARTS["enc0"] = "SELECT SubcategoryName, CAST(row_number() OVER (ORDER BY SubcategoryName) - 1 AS INT) AS id FROM (SELECT DISTINCT SubcategoryName FROM dlyb) d"
PARTS["enc1"] = """SELECT * FROM enc0 UNION ALL SELECT SubcategoryName, CAST(row_number() OVER (ORDER BY SubcategoryName) - 1 + (SELECT max(id) + 1 FROM enc0) AS INT)
    FROM (SELECT SubcategoryName FROM subcategories WHERE SubcategoryName NOT IN (SELECT SubcategoryName FROM enc0)) n"""


@query("extend_encoding", "SELECT * FROM enc1")
def _(t: Tables):
    known = encoding.extend_encoding(None, daily_b(t))
    return encoding.extend_encoding(known, t.subcategories, daily_b(t))


@query("encode_items", "SELECT d.OrderDate, e.id AS SubcategoryName, d.OrderQuantity FROM dlyb d JOIN enc0 e USING (SubcategoryName)")
def _(t: Tables):
    mapping = encoding.extend_encoding(None, daily_b(t))
    return encoding.encode_items(daily_b(t).select("OrderDate", ITEM, "OrderQuantity"), mapping)


@query(
    "decode_items",
    """SELECT CAST(p.ProductSubcategoryKey AS VARCHAR) AS item_id, coalesce(e.SubcategoryName, 'Unknown_ID_' || p.ProductSubcategoryKey) AS item_name, count(*) AS products
       FROM products p LEFT JOIN enc0 e ON e.id = p.ProductSubcategoryKey GROUP BY 1, 2""",
)
def _(t: Tables):
    mapping = encoding.extend_encoding(None, daily_b(t))
    docs = t.products.groupBy(F.col("ProductSubcategoryKey").cast("string").alias("item_id")).agg(F.count(F.lit(1)).alias("products"))
    return encoding.decode_items(docs, mapping, "item_id")


@query("ordinal_codes", "SELECT SubcategoryName, id AS code FROM enc0")
def _(t: Tables):
    return encoding.ordinal_codes(daily_b(t).select(ITEM).distinct(), ITEM, "code")


@query(
    "one_hot_events",
    """SELECT CategoryName, sum(CASE WHEN event = 'Black Friday' THEN 1.0 ELSE 0 END) AS bf, sum(CASE WHEN event = 'Cyber Monday' THEN 1.0 ELSE 0 END) AS cm,
              sum(CASE WHEN event = 'No Promo' THEN 1.0 ELSE 0 END) AS np FROM price_events GROUP BY 1""",
)
def _(t: Tables):
    hot = encoding.one_hot(F.col("event"), ["Back to School", "Black Friday", "Cyber Monday", "No Promo"])
    df = t.price_events.select("CategoryName", *hot)
    return df.groupBy("CategoryName").agg(F.sum("is_Black Friday").alias("bf"), F.sum("is_Cyber Monday").alias("cm"), F.sum("is_No Promo").alias("np"))


@query(
    "min_max_scale",
    "SELECT OrderDate, SubcategoryName, OrderQuantity / (SELECT max(OrderQuantity) FROM pnl) AS OrderQuantity FROM pnl",
)
def _(t: Tables):
    return encoding.min_max(panel_a(t), ["OrderQuantity"]).select("OrderDate", ITEM, "OrderQuantity")


# --- windows ---------------------------------------------------------------


@query(
    "lagged_sales",
    """SELECT ReturnDate, SubcategoryName, OrderQuantity, CAST(floor(coalesce(l, avg(l) OVER (PARTITION BY SubcategoryName))) AS INT) AS OrderQuantity_Lag1
       FROM (SELECT *, lag(OrderQuantity) OVER (PARTITION BY SubcategoryName ORDER BY ReturnDate) AS l FROM rpnl) x""",
)
def _(t: Tables):
    return panels.lagged_sales(returns_panel(t)).select("ReturnDate", ITEM, "OrderQuantity", "OrderQuantity_Lag1")


_W = "(PARTITION BY SubcategoryName ORDER BY OrderDate"


@query(
    "lags",
    f"SELECT OrderDate, SubcategoryName, lag(OrderQuantity, 1) OVER {_W}) AS lag_1, lag(OrderQuantity, 2) OVER {_W}) AS lag_2, lag(OrderQuantity, 3) OVER {_W}) AS lag_3, "
    f"lag(OrderQuantity, 7) OVER {_W}) AS lag_7, lag(OrderQuantity, 14) OVER {_W}) AS lag_14 FROM pnl",
)
def _(t: Tables):
    return panels.lags(panel_a(t), "OrderQuantity", [1, 2, 3, 7, 14]).drop("OrderQuantity", "StockDate")


@query(
    "rolling_means",
    f"""SELECT OrderDate, SubcategoryName,
          CASE WHEN count(*) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN round(avg(OrderQuantity) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) END AS rolling_mean_7,
          CASE WHEN count(*) OVER {_W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) = 14 THEN round(avg(OrderQuantity) OVER {_W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) END AS rolling_mean_14
        FROM pnl""",
)
def _(t: Tables):
    df = panels.rolling_means(panel_a(t), "OrderQuantity", [7, 14])
    return df.select("OrderDate", ITEM, F.round("rolling_mean_7", 6).alias("rolling_mean_7"), F.round("rolling_mean_14", 6).alias("rolling_mean_14"))


PARTS["roll"] = f"""SELECT *, CASE WHEN count(*) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
        THEN median(OrderQuantity) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS m7,
    CASE WHEN count(*) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
        THEN round(stddev_samp(OrderQuantity) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) END AS s7 FROM pnl"""


@query("rolling_median_and_std", "SELECT OrderDate, SubcategoryName, m7 AS rolling_median_7, s7 AS moving_std_7 FROM roll")
def _(t: Tables):
    df = panels.rolling_std(panels.rolling_median(panel_a(t), "OrderQuantity"), "OrderQuantity")
    return df.select("OrderDate", ITEM, "rolling_median_7", F.round("moving_std_7", 5).alias("moving_std_7"))


@query("acceleration", f"SELECT OrderDate, SubcategoryName, lag(OrderQuantity) OVER {_W}) - lag(m7) OVER {_W}) AS acceleration FROM roll")
def _(t: Tables):
    df = panels.lags(panels.rolling_median(panel_a(t), "OrderQuantity"), "OrderQuantity", [1])
    return panels.acceleration(df).select("OrderDate", ITEM, "acceleration")


@query(
    "walk_forward_mean",
    """SELECT ReturnDate, SubcategoryName, round(coalesce(avg(ReturnQuantity) OVER (PARTITION BY SubcategoryName ORDER BY ReturnDate ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 0), 6) AS ColdStart_Pred FROM rpnl""",
)
def _(t: Tables):
    df = panels.walk_forward_mean(returns_panel(t), "ReturnQuantity", 15, "ReturnDate")
    return df.select("ReturnDate", ITEM, F.round("ColdStart_Pred", 6).alias("ColdStart_Pred"))


@query(
    "tail_statistics",
    """SELECT SubcategoryName, round(avg(OrderQuantity) FILTER (WHERE rn <= 7), 6) AS mean_7, round(avg(OrderQuantity) FILTER (WHERE rn <= 14), 6) AS mean_14,
              round(avg(OrderQuantity) FILTER (WHERE rn <= 15), 6) AS mean_15, median(OrderQuantity) AS median_30
       FROM (SELECT *, row_number() OVER (PARTITION BY SubcategoryName ORDER BY OrderDate DESC) AS rn FROM dlyb) x WHERE rn <= 30 GROUP BY 1""",
)
def _(t: Tables):
    df = panels.tail_stats(daily_b(t), "OrderQuantity")
    return df.withColumns({f"mean_{n}": F.round(f"mean_{n}", 6) for n in (7, 14, 15)})


@query(
    "sliding_sequences",
    f"""SELECT SubcategoryName, OrderDate, target, round(s, 6) AS feature_sum FROM (
          SELECT SubcategoryName, OrderDate, OrderQuantity AS target, count(*) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n,
                 sum(OrderQuantity + 2 * (isodow(OrderDate) - 1)) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s FROM pnl) x WHERE n = 7""",
)
def _(t: Tables):
    df = panels.sequences(panel_a(t).withColumn("dow", F.weekday("OrderDate")), ["OrderQuantity", "dow"], "OrderQuantity", 7)
    total = F.aggregate("features", F.lit(0.0), lambda s, row: s + F.get(row, F.lit(0)) + F.get(row, F.lit(1)) * 2)
    return df.select(ITEM, "OrderDate", "target", F.round(total, 6).alias("feature_sum"))


@query(
    "feature_table",
    f"""SELECT f.OrderDate, f.SubcategoryName, round(ln(1 + f.OrderQuantity), 6) AS OrderQuantity, (SELECT count(*) FROM subcategories s WHERE s.SubcategoryName < f.SubcategoryName) AS Subcategory_Encoded,
          month(f.OrderDate) AS month, isodow(f.OrderDate) - 1 AS dayofweek, dayofyear(f.OrderDate) AS dayofyear, CAST(isodow(f.OrderDate) >= 6 AS INT) AS is_weekend,
          round(coalesce(lag(ln(1 + f.OrderQuantity), 1) OVER {_W}), 0), 6) AS lag_1, round(coalesce(lag(ln(1 + f.OrderQuantity), 7) OVER {_W}), 0), 6) AS lag_7,
          round(coalesce(CASE WHEN count(*) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 THEN median(ln(1 + f.OrderQuantity)) OVER {_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 0), 6) AS rolling_median_7,
          (SELECT count(*) FROM subcategories s WHERE s.SubcategoryName < f.SubcategoryName) * CAST(isodow(f.OrderDate) >= 6 AS INT) AS cat_weekend_inter
        FROM pnl f""",
)
def _(t: Tables):
    df = panels.feature_table(panel_a(t))
    rounded = ("OrderQuantity", "lag_1", "lag_7", "rolling_median_7")
    return df.withColumns({c: F.round(c, 6) for c in rounded}).select(
        "OrderDate", ITEM, "OrderQuantity", "Subcategory_Encoded", "month", "dayofweek", "dayofyear", "is_weekend",
        "lag_1", "lag_7", "rolling_median_7", "cat_weekend_inter",
    )


@query(
    "lag_feature_table",
    """SELECT OrderDate, SubcategoryName, round(ln(1 + OrderQuantity), 6) AS target_log, round(l14, 6) AS lag_14, round(r14, 6) AS rolling_mean_14 FROM (
         SELECT *, lag(ln(1 + OrderQuantity), 14) OVER w AS l14, avg(ln(1 + OrderQuantity)) OVER (PARTITION BY SubcategoryName ORDER BY OrderDate ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS r14
         FROM dlyb WINDOW w AS (PARTITION BY SubcategoryName ORDER BY OrderDate)) x WHERE l14 IS NOT NULL""",
)
def _(t: Tables):
    df = panels.lag_feature_table(daily_b(t))
    return df.select("OrderDate", ITEM, F.round("target_log", 6).alias("target_log"), F.round("lag_14", 6).alias("lag_14"), F.round("rolling_mean_14", 6).alias("rolling_mean_14"))


# --- splits ----------------------------------------------------------------


@query("split_last_days", "SELECT OrderDate, SubcategoryName, CASE WHEN OrderDate <= (SELECT max(OrderDate) - 30 FROM pnl) THEN 'train' ELSE 'test' END AS part FROM pnl")
def _(t: Tables):
    return panels.split_last_days(panel_a(t)).select("OrderDate", ITEM, "part")


PARTS["numbered"] = "SELECT *, row_number() OVER (ORDER BY OrderDate, SubcategoryName) - 1 AS i, count(*) OVER () AS n FROM pnl"


@query("split_by_share", "SELECT OrderDate, SubcategoryName, i AS row_index, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM numbered")
def _(t: Tables):
    return panels.split_by_share(panel_a(t)).select("OrderDate", ITEM, "row_index", "part")


@query("split_last_months", "SELECT OrderDate, SubcategoryName, OrderQuantity FROM pnl WHERE OrderDate >= (SELECT CAST(max(OrderDate) - INTERVAL 3 MONTH AS DATE) FROM pnl)")
def _(t: Tables):
    return panels.split_last_months(panel_a(t)).select("OrderDate", ITEM, "OrderQuantity")


@query(
    "time_folds",
    """SELECT OrderDate, SubcategoryName, fold, CASE WHEN i < n - (n // 6) * (6 - fold) THEN 'train' ELSE 'test' END AS role
       FROM numbered, (SELECT unnest(generate_series(1, 5)) AS fold) f WHERE i < n - (n // 6) * (5 - fold)""",
)
def _(t: Tables):
    return panels.time_folds(panel_a(t), 5).select("OrderDate", ITEM, "fold", "role")


# --- forecasts -------------------------------------------------------------

PARTS["cold"] = """SELECT SubcategoryName, median(OrderQuantity) * least(1.2, greatest(0.8, CASE WHEN avg(OrderQuantity) FILTER (WHERE age < 14) > 0
        THEN avg(OrderQuantity) FILTER (WHERE age < 7) / avg(OrderQuantity) FILTER (WHERE age < 14) ELSE 1.0 END)) AS yhat
    FROM (SELECT *, date_diff('day', OrderDate, (SELECT max(OrderDate) FROM pnlb)) AS age FROM pnlb) x WHERE age < 30 GROUP BY 1"""
PARTS["coldday"] = """SELECT SubcategoryName, CAST((SELECT max(OrderDate) FROM pnlb) + CAST(s AS INT) AS DATE) AS date, yhat
    FROM cold, (SELECT unnest(generate_series(1, 30)) AS s) g"""


@query("cold_start_forecast", "SELECT SubcategoryName, date, round(yhat, 6) AS yhat FROM coldday")
def _(t: Tables):
    return forecast.cold_start(panel_b(t)).withColumn("yhat", F.round("yhat", 6))


def cold_daily(t: Tables) -> DataFrame:
    return forecast.dispatch({}, forecast.cold_start(panel_b(t)))


PARTS["colddisp"] = "SELECT SubcategoryName, 'ColdStart' AS model_source, 'Low (60-65%)' AS confidence_level, date, greatest(round_even(yhat, 2), 0) AS qty FROM coldday"


@query("forecast_dispatch_cold", "SELECT SubcategoryName, model_source, confidence_level, count(*) AS days, round(sum(qty), 2) AS total FROM colddisp GROUP BY 1, 2, 3")
def _(t: Tables):
    docs = forecast.forecast_documents(cold_daily(t))
    return docs.select(F.col("item_id").alias(ITEM), "model_source", "confidence_level", F.size("daily_forecast").cast("long").alias("days"), F.round("total_horizon_volume", 2).alias("total"))


@query(
    "stocking_report",
    """SELECT SubcategoryName AS item_id, round(sum(qty), 2) AS forecasted_sales_total, round(sum(qty) * 0.15, 1) AS safety_stock_estimate,
              round(sum(qty) * 1.15, 1) AS total_stock_recommendation, 'ColdStart' AS model_used, 'Volatility-Adjusted' AS stock_logic FROM colddisp GROUP BY 1""",
)
def _(t: Tables):
    df = inventory.stocking_report(cold_daily(t))
    return df.withColumns({"safety_stock_estimate": F.round("safety_stock_estimate", 1), "total_stock_recommendation": F.round("total_stock_recommendation", 1)})


@query("forecast_load", "SELECT date, round(sum(qty), 2) AS units FROM colddisp GROUP BY 1")
def _(t: Tables):
    return inventory.forecast_load(cold_daily(t)).withColumn("units", F.round("units", 2))


PARTS["bench"] = """SELECT avg(u) FILTER (WHERE age < 30) AS prev_month, coalesce(avg(u) FILTER (WHERE age BETWEEN 305 AND 335), 0) AS last_year
    FROM (SELECT date_diff('day', OrderDate, (SELECT max(OrderDate) FROM pnl)) AS age, sum(OrderQuantity) AS u FROM pnl GROUP BY 1) d"""


@query(
    "staffing_benchmark",
    """SELECT round(prev_month, 4) AS prev_month, round(last_year, 4) AS last_year, round(CASE WHEN last_year > prev_month * 0.7 THEN last_year ELSE prev_month END, 4) AS benchmark,
              CASE WHEN last_year > prev_month * 0.7 THEN 'Same Month Prev Year' ELSE 'Prev Month Average' END AS benchmark_name FROM bench""",
)
def _(t: Tables):
    df = inventory.staffing_benchmark(panel_a(t))
    return df.withColumns({c: F.round(c, 4) for c in ("prev_month", "last_year", "benchmark")})


def recent_load(t: Tables) -> DataFrame:
    """Observed load of the last 60 days stands in for a varying forecast."""
    p = panel_a(t)
    recent = clean.trailing_days(p, "OrderDate", 59)
    return recent.groupBy(F.col("OrderDate").alias("date")).agg(F.sum("OrderQuantity").cast("double").alias("units"))


PARTS["rload"] = "SELECT OrderDate AS date, CAST(sum(OrderQuantity) AS DOUBLE) AS units FROM pnl WHERE OrderDate >= (SELECT max(OrderDate) - 59 FROM pnl) GROUP BY 1"


@query(
    "staffing_alerts",
    """SELECT date, units, round(b, 4) AS benchmark FROM rload, (SELECT CASE WHEN last_year > prev_month * 0.7 THEN last_year ELSE prev_month END AS b FROM bench) x WHERE units > b * 1.2""",
)
def _(t: Tables):
    return inventory.staffing_alerts(recent_load(t), inventory.staffing_benchmark(panel_a(t))).withColumn("benchmark", F.round("benchmark", 4))


_DOW = ", ".join(f"round(coalesce(avg(units) FILTER (WHERE isodow(date) = {i + 1}), 0), 6) AS {d}" for i, d in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")))


@query("staffing_calendar", f"SELECT CAST((day(date) - 1) // 7 + 1 AS INT) AS Week, {_DOW} FROM rload GROUP BY 1")
def _(t: Tables):
    df = inventory.staffing_calendar(recent_load(t))
    return df.withColumns({d: F.round(d, 6) for d in df.columns if d != "Week"})


@query("peak_days", "SELECT date, units, strftime(date, '%a') AS weekday FROM rload WHERE units > (SELECT avg(units) + 1.5 * stddev_samp(units) FROM rload)")
def _(t: Tables):
    return inventory.peak_days(recent_load(t))


@query("busy_days", "SELECT date, units, strftime(date, '%a') AS weekday FROM rload WHERE units > (SELECT avg(units) * 1.2 FROM rload)")
def _(t: Tables):
    return inventory.peak_days(recent_load(t), factor=1.2)


# returns chain

PARTS["ahead"] = """SELECT p.SubcategoryName, s.step, coalesce(f.q, p.m) AS sale FROM (SELECT SubcategoryName, avg(OrderQuantity) AS m FROM rpnl GROUP BY 1) p
    CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS step) s
    LEFT JOIN (SELECT SubcategoryName, row_number() OVER (PARTITION BY SubcategoryName ORDER BY OrderDate) AS step, OrderQuantity AS q FROM pnl
               WHERE OrderDate > (SELECT max(OrderDate) - 20 FROM pnl)) f ON f.SubcategoryName = p.SubcategoryName AND f.step = s.step"""
PARTS["rrec"] = """SELECT SubcategoryName, avg(ReturnQuantity) AS rm, CASE WHEN avg(OrderQuantity) > 0 THEN avg(OrderQuantity) ELSE 1 END AS sm FROM rpnl
    WHERE ReturnDate > (SELECT max(ReturnDate) - 15 FROM rpnl) GROUP BY 1"""


def sales_ahead(t: Tables) -> DataFrame:
    """Twenty observed days stand in for the sales forecast; ten are padded."""
    p = panel_a(t)
    seen = clean.trailing_days(p, "OrderDate", 19).select(ITEM, F.col("OrderDate").alias("date"), F.col("OrderQuantity").alias("qty"))
    return forecast.future_sales(returns_panel(t), seen, 30)


@query("sales_feed_padded", "SELECT SubcategoryName, step, round(sale, 6) AS sale FROM ahead")
def _(t: Tables):
    df = sales_ahead(t).select(ITEM, F.posexplode("exog").alias("step", "sale"))
    return df.select(ITEM, (F.col("step") + 1).cast("long").alias("step"), F.round("sale", 6).alias("sale"))


@query(
    "cold_start_returns",
    """SELECT a.SubcategoryName, round(sum(r.rm * a.sale / r.sm), 4) AS total FROM ahead a JOIN rrec r USING (SubcategoryName) GROUP BY 1""",
)
def _(t: Tables):
    daily = forecast.cold_start_returns(returns_panel(t), sales_ahead(t))
    return daily.groupBy(ITEM).agg(F.round(F.sum("yhat"), 4).alias("total"))


@query(
    "returns_summary",
    """SELECT a.SubcategoryName, CAST(round_even(greatest(sum(r.rm * a.sale / r.sm), 0), 0) AS INT) AS Predicted_Returns_Total, '65.0%' AS Confidence_Rating, 'ColdStart' AS Model_Used,
              (SELECT max(ReturnDate) + 1 FROM rpnl) AS Forecast_Start, (SELECT max(ReturnDate) + 30 FROM rpnl) AS Forecast_End FROM ahead a JOIN rrec r USING (SubcategoryName) GROUP BY 1""",
)
def _(t: Tables):
    daily = forecast.cold_start_returns(returns_panel(t), sales_ahead(t)).withColumn("model_source", F.lit("ColdStart"))
    return forecast.returns_summary(daily)


_V0, _V1 = "2001-06-01", "2001-06-30"
PARTS["vmonth"] = f"SELECT SubcategoryName, CAST(sum(ReturnQuantity) AS BIGINT) AS a, avg(OrderQuantity) AS sn FROM rpnl WHERE ReturnDate BETWEEN DATE '{_V0}' AND DATE '{_V1}' GROUP BY 1"
PARTS["vbase"] = f"SELECT SubcategoryName, avg(OrderQuantity) AS sb FROM rpnl WHERE ReturnDate < DATE '{_V0}' GROUP BY 1"
for _k in (30, 15):
    PARTS[f"vrec{_k}"] = f"""SELECT SubcategoryName, avg(ReturnQuantity) AS m, stddev_samp(ReturnQuantity) AS s FROM rpnl
        WHERE ReturnDate < DATE '{_V0}' AND ReturnDate >= DATE '{_V0}' - {_k} GROUP BY 1"""
PARTS["v30"] = """SELECT SubcategoryName, a, m * 30 AS p, (m - 1.96 * e) * 30 AS l, (m + 1.96 * e) * 30 AS u
    FROM (SELECT *, CASE WHEN s > 0 THEN s / sqrt(30) ELSE 0.1 END AS e FROM vrec30 JOIN vmonth USING (SubcategoryName)) x"""
PARTS["v15"] = """SELECT SubcategoryName, a, coalesce(m * f * 30, 0) AS p, coalesce(m * f * 30 - 1.96 * (s / sqrt(15)) * 30 * f, 0) AS l,
        coalesce(m * f * 30 + 1.96 * (s / sqrt(15)) * 30 * f, 0) AS u
    FROM (SELECT *, sn / nullif(sb, 0) AS f FROM vrec15 JOIN vmonth USING (SubcategoryName) JOIN vbase USING (SubcategoryName)) x"""


def _validation(part: str, upper: str, div: int) -> str:
    return f"""SELECT SubcategoryName, a AS Actual_Return, CAST(p0 AS BIGINT) AS Predicted_Returns, CAST(l0 AS BIGINT) AS Lower_Bound, CAST(u0 AS BIGINT) AS Upper_Bound,
          CASE WHEN p0 > 0 THEN round_even(greatest(0, least(100, 100 * (1 - (u0 - l0) / (p0 + 1) / {div}))), 2) ELSE 0 END AS Confidence_Rating, 'ColdStart' AS Return_Model
        FROM (SELECT *, {upper} AS u0 FROM (SELECT *, round_even(greatest(0, p), 0) AS p0, round_even(greatest(0, l), 0) AS l0 FROM {part}) y) z"""


@query("returns_validation", _validation("v30", "CASE WHEN p0 > 0 THEN round_even(least(p0 * 3, u), 0) ELSE round_even(u, 0) END", 2))
def _(t: Tables):
    return forecast.returns_validation(returns_panel(t), _V0, _V1)


@query("returns_validation_scaled", _validation("v15", "round_even(u, 0)", 4))
def _(t: Tables):
    return forecast.returns_validation(returns_panel(t), _V0, _V1, scaled=True)


# trained models: properties only

PARTS["arlag"] = """SELECT SubcategoryName, OrderDate, CAST(OrderQuantity AS DOUBLE) AS y, CAST(lag(OrderQuantity, 1) OVER w AS DOUBLE) AS l1, CAST(lag(OrderQuantity, 7) OVER w AS DOUBLE) AS l7
    FROM pnl WINDOW w AS (PARTITION BY SubcategoryName ORDER BY OrderDate)"""
PARTS["araug"] = """SELECT SubcategoryName, [[CAST(count(*) AS DOUBLE), sum(l1), sum(l7), sum(y)], [sum(l1), sum(l1 * l1), sum(l1 * l7), sum(l1 * y)],
      [sum(l7), sum(l1 * l7), sum(l7 * l7), sum(l7 * y)]] AS m FROM arlag WHERE l7 IS NOT NULL GROUP BY 1"""
PARTS["arsolved"] = solved("araug", "SubcategoryName")
# An item that never sold has a singular system; its least-norm coefficients are zero.
PARTS["arcoef"] = """SELECT SubcategoryName, list_transform([m[1][4], m[2][4], m[3][4]], lambda v: CASE WHEN isfinite(v) THEN v ELSE 0.0 END) AS c FROM arsolved"""
PARTS["arseen"] = """SELECT SubcategoryName, list(y ORDER BY OrderDate) AS seen FROM (
      SELECT * FROM arlag QUALIFY row_number() OVER (PARTITION BY SubcategoryName ORDER BY OrderDate DESC) <= 7) x GROUP BY 1"""


@query(
    "autoregressive_forecast",
    """SELECT SubcategoryName, CAST((SELECT max(OrderDate) FROM pnl) + CAST(s AS INT) AS DATE) AS date, round(seen[-1], 4) + 0.0 AS yhat FROM (
         WITH RECURSIVE ahead AS (
           SELECT SubcategoryName, 0 AS s, seen, c FROM arseen JOIN arcoef USING (SubcategoryName)
           UNION ALL
           SELECT SubcategoryName, s + 1, list_append(seen, c[1] + c[2] * seen[-1] + c[3] * seen[-7]), c FROM ahead WHERE s < 30)
         SELECT * FROM ahead WHERE s > 0) x""",
)
def _(t: Tables):
    p = written(panel_a(t))
    ahead = forecast.autoregression_forecast(forecast.fit_autoregression(p), p)
    return ahead.withColumn("yhat", F.round("yhat", 4) + 0.0)


def _season(day: str) -> str:
    """List of the 15 regressors of the seasonal model on a day."""
    t = f"CAST(date_diff('day', DATE '1970-01-05', {day}) AS DOUBLE)"
    waves = [f"{f}({t} * 2 * pi() * {k} / {period})" for period in ("7.0", "365.25") for k in (1, 2, 3) for f in ("sin", "cos")]
    payday = f"CASE WHEN day({day}) IN (15, 30) THEN 1.0 ELSE 0.0 END"
    return f"[1.0::DOUBLE, {t} / 365.0, {', '.join(waves)}, {payday}]"


PARTS["sdays"] = f"SELECT SubcategoryName, CAST(OrderQuantity AS DOUBLE) AS y, {_season('OrderDate')} AS x FROM pnl WHERE SubcategoryName IN (SELECT SubcategoryName FROM pnl GROUP BY 1 HAVING sum(OrderQuantity) >= 5)"
PARTS["saug"] = """SELECT SubcategoryName, list(row ORDER BY i) AS m FROM (
      SELECT SubcategoryName, i, list_append(list(CASE WHEN i = j AND i > 1 THEN g + 1e-3 ELSE g END ORDER BY j), any_value(b)) AS row FROM (
        SELECT SubcategoryName, i, j, sum(x[i] * x[j]) AS g, sum(x[i] * y) AS b FROM sdays, (SELECT unnest(range(1, 16)) AS i) a, (SELECT unnest(range(1, 16)) AS j) c
        GROUP BY 1, 2, 3) s GROUP BY 1, 2) r GROUP BY 1"""
PARTS["ssolved"] = solved("saug", "SubcategoryName")


@query(
    "seasonal_forecast",
    f"""SELECT SubcategoryName, date, round(list_sum(list_transform(range(1, 16), lambda i: x[i] * m[i][16])), 4) + 0.0 AS yhat
        FROM ssolved CROSS JOIN (SELECT date, {_season('date')} AS x FROM (
          SELECT CAST((SELECT max(OrderDate) FROM pnl) + CAST(s AS INT) AS DATE) AS date FROM (SELECT unnest(range(1, 31)) AS s) h) d) f""",
)
def _(t: Tables):
    p = written(panel_a(t))
    models = forecast.fit_seasonal(p, regressors=forecast.payday_regressor(F.col("OrderDate")))
    ahead = forecast.seasonal_forecast(models, p, regressors=forecast.payday_regressor(F.col("date")))
    return ahead.withColumn("yhat", F.round("yhat", 4) + 0.0)


@query("sales_forecast_dispatch")
def _(t: Tables):
    return demand.sales_forecast(written(panel_a(t)))


@query("returns_forecast_dispatch")
def _(t: Tables):
    # Both panels start from the same daily sales.
    sold = staged(daily_a(t), "sold")
    sales = panels.sales_panel(sold, t.subcategories)
    returns = returns_panel(t, sold.select("OrderDate", ITEM, "OrderQuantity"))
    return demand.returns_forecast(written(returns), demand.sales_forecast(written(sales)))


@query("fallback_evaluation")
def _(t: Tables):
    return demand.evaluate_with_fallback(written(panel_a(t)))


# --- evaluation given predictions ------------------------------------------
# The previous week's quantity is the prediction: exact in both engines.


def naive_scores(t: Tables) -> DataFrame:
    df = panels.lags(panel_a(t), "OrderQuantity", [7]).filter(F.col("lag_7").isNotNull())
    return df.select("OrderDate", ITEM, F.col("OrderQuantity").alias("actual"), F.col("lag_7").alias("pred"))


PARTS["nv"] = f"SELECT * FROM (SELECT OrderDate, SubcategoryName, OrderQuantity AS actual, lag(OrderQuantity, 7) OVER {_W}) AS pred FROM pnl) x WHERE pred IS NOT NULL"
_ERR = """round(sqrt(avg(power(actual - pred, 2))), 6) AS rmse, round(100 * avg(2 * abs(pred - actual) / (abs(actual) + abs(pred) + 1e-10)), 6) AS smape,
    round(100 * avg(CASE WHEN abs(actual) + abs(pred) = 0 THEN 0 ELSE 2 * abs(pred - actual) / (abs(actual) + abs(pred)) END), 6) AS smape_safe,
    round(avg(CASE WHEN actual <> 0 THEN abs(pred - actual) / abs(actual) END), 6) AS mape,
    round(1 - sum(power(actual - pred, 2)) / (var_pop(actual) * count(*)), 6) AS r2"""
PARTS["errs"] = f"SELECT SubcategoryName, count(*) AS n, {_ERR} FROM nv GROUP BY 1"


def _rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("error_metrics", "SELECT * FROM errs")
def _(t: Tables):
    return _rounded(evaluate.error_metrics(naive_scores(t), [ITEM]), ("rmse", "smape", "smape_safe", "mape", "r2"))


@query(
    "metric_summary",
    """SELECT 'rmse' AS metric, round(avg(rmse), 4) AS mean, round(median(rmse), 4) AS median, round(min(rmse), 4) AS min, round(max(rmse), 4) AS max FROM errs
       UNION ALL SELECT 'smape', round(avg(smape), 4), round(median(smape), 4), round(min(smape), 4), round(max(smape), 4) FROM errs""",
)
def _(t: Tables):
    m = evaluate.metric_summary(evaluate.error_metrics(naive_scores(t), [ITEM]), ["rmse", "smape"])
    return _rounded(m, ("mean", "median", "min", "max"), 4)


@query("residuals_by_actual", "SELECT actual, round(avg(actual - pred), 6) AS residual FROM nv GROUP BY 1")
def _(t: Tables):
    return _rounded(evaluate.residuals_by_actual(naive_scores(t)), ("residual",))


@query("daily_error", "SELECT OrderDate, round(avg(actual - pred), 6) AS mean_error FROM nv GROUP BY 1")
def _(t: Tables):
    return _rounded(evaluate.daily_error(naive_scores(t)), ("mean_error",))


@query(
    "fit_quality",
    f"SELECT n, r2, mape, CASE WHEN r2 > 0.8 AND mape < 0.1 THEN 'EXECUTIVE READY' ELSE 'REVISE MODEL' END AS status FROM (SELECT count(*) AS n, {_ERR} FROM nv) x",
)
def _(t: Tables):
    return _rounded(evaluate.fit_quality(naive_scores(t)), ("r2", "mape"))


PARTS["lastm"] = "SELECT * FROM nv WHERE OrderDate > (SELECT max(OrderDate) - 30 FROM pnl)"
PARTS["bt"] = """SELECT SubcategoryName, CAST(sum(actual) AS BIGINT) AS a, CAST(sum(pred) AS BIGINT) AS p, sqrt(avg(power(actual - pred, 2))) AS rmse, count(*) AS d FROM lastm GROUP BY 1"""


@query(
    "backtest_table",
    """SELECT SubcategoryName, a AS Actual_Month_Sales, p AS Predicted_Month_Sales, CAST(round_even(p + 1.65 * rmse * sqrt(d), 0) AS BIGINT) AS Safety_Stock_Level,
              round(least(1, greatest(0, 1 - abs(a - p) / a)) * 100, 6) AS Accuracy, coalesce(round_even(abs(a - p) / nullif(a, 0) * 100, 2), 0) AS APE FROM bt""",
)
def _(t: Tables):
    df = clean.trailing_days(naive_scores(t), "OrderDate", 29)
    out = inventory.backtest_table(df)
    return _rounded(out, ("Accuracy",))


# --- growth and status -----------------------------------------------------


def month_forecast(t: Tables) -> DataFrame:
    """Last month and a naive forecast (the 30 days before it) of items sold recently."""
    p = daily_b(t)
    newest = p.agg(F.max("OrderDate")).scalar()
    age = F.datediff(newest, F.col("OrderDate"))
    sums = p.filter(age < 60).groupBy(ITEM).agg(
        F.coalesce(F.sum(F.when(age < 30, F.col("OrderQuantity"))), F.lit(0)).alias("Last_Month_Actual"),
        F.coalesce(F.sum(F.when(age >= 30, F.col("OrderQuantity"))), F.lit(0)).alias("Future_Forecast"),
    )
    return sums.withColumn("Safe_Stock_Level", F.col("Future_Forecast") * 2)


PARTS["mfc"] = """SELECT SubcategoryName, CAST(coalesce(sum(OrderQuantity) FILTER (WHERE age < 30), 0) AS BIGINT) AS Last_Month_Actual,
        CAST(coalesce(sum(OrderQuantity) FILTER (WHERE age >= 30), 0) AS BIGINT) AS Future_Forecast, CAST(coalesce(sum(OrderQuantity) FILTER (WHERE age >= 30), 0) * 2 AS BIGINT) AS Safe_Stock_Level
    FROM (SELECT *, date_diff('day', OrderDate, (SELECT max(OrderDate) FROM dlyb)) AS age FROM dlyb) x WHERE age < 60 GROUP BY 1"""
PARTS["mfull"] = """SELECT * FROM mfc UNION ALL SELECT SubcategoryName, 0, 2, 5 FROM (SELECT SubcategoryName FROM subcategories UNION SELECT SubcategoryName FROM word_items) i
    WHERE SubcategoryName NOT IN (SELECT SubcategoryName FROM mfc)"""


def full_forecast(t: Tables) -> DataFrame:
    return inventory.complete_list(month_forecast(t), t.word_items.select(ITEM).union(t.subcategories.select(ITEM)))


@query("complete_list", "SELECT * FROM mfull")
def _(t: Tables):
    return full_forecast(t)


@query("inventory_status", "SELECT *, CASE WHEN Future_Forecast > Last_Month_Actual THEN 'Risk' WHEN Safe_Stock_Level > 200 THEN 'Heavy' ELSE 'OK' END AS Stock_Status FROM mfull")
def _(t: Tables):
    return inventory.inventory_status(full_forecast(t))


@query("volume_status", "SELECT *, CASE WHEN Safe_Stock_Level > 100 THEN 'High' WHEN Safe_Stock_Level > 60 THEN 'Moderate' ELSE 'Normal' END AS Volume_Status FROM mfull")
def _(t: Tables):
    return inventory.volume_status(full_forecast(t))


@query(
    "month_over_month",
    """SELECT SubcategoryName, Last_Month_Actual, Future_Forecast, round(g, 6) AS mom_growth_pct, CASE WHEN g > 5 THEN 'Increase' WHEN g < -5 THEN 'Decrease' ELSE 'Stagnant' END AS Trend
       FROM (SELECT *, (Future_Forecast - Last_Month_Actual) / CASE WHEN Last_Month_Actual = 0 THEN 1 ELSE Last_Month_Actual END * 100 AS g FROM mfull) x""",
)
def _(t: Tables):
    return _rounded(inventory.month_over_month(full_forecast(t)), ("mom_growth_pct",)).drop("Safe_Stock_Level")


@query(
    "year_over_year",
    """SELECT SubcategoryName, Future_Forecast, base_units, round(g, 6) AS yoy_growth_pct, CASE WHEN g > 5 THEN 'Booming' WHEN g >= 1 THEN 'Growing' WHEN g >= -1 THEN 'Flat' ELSE 'Declining' END AS Status
       FROM (SELECT m.SubcategoryName, Future_Forecast, coalesce(b, 0) AS base_units, (Future_Forecast - coalesce(b, 0)) / CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE b END * 100 AS g
             FROM mfull m LEFT JOIN (SELECT SubcategoryName, CAST(sum(OrderQuantity) AS BIGINT) AS b FROM dlyb WHERE OrderDate BETWEEN DATE '2001-01-01' AND DATE '2001-01-31' GROUP BY 1) h USING (SubcategoryName)) x""",
)
def _(t: Tables):
    df = inventory.year_over_year(full_forecast(t), daily_b(t), "2001-01-01", "2001-01-31")
    return _rounded(df, ("yoy_growth_pct",)).drop("Safe_Stock_Level", "Last_Month_Actual")


@query(
    "lifetime_growth",
    """SELECT f AS first_month_units, l AS last_month_units, round(CASE WHEN f > 0 THEN (l - f) / f * 100 ELSE 0 END, 6) AS lifetime_growth_pct
       FROM (SELECT arg_min(u, m) AS f, arg_max(u, m) AS l FROM (SELECT date_trunc('month', OrderDate) AS m, CAST(sum(OrderQuantity) AS BIGINT) AS u FROM sales GROUP BY 1) s) x""",
)
def _(t: Tables):
    return _rounded(inventory.lifetime_growth(t.sales), ("lifetime_growth_pct",))


@query(
    "growth_summary",
    """SELECT f AS forecast_units, b AS base_units, r AS recent_units, round((f - b) / b * 100, 6) AS growth_vs_base, round((f - r) / r * 100, 6) AS momentum FROM (
         SELECT (SELECT CAST(sum(Future_Forecast) AS BIGINT) FROM mfull) AS f, CAST(sum(OrderQuantity) FILTER (WHERE date_trunc('month', OrderDate) = DATE '1996-08-01') AS BIGINT) AS b,
                CAST(sum(OrderQuantity) FILTER (WHERE date_trunc('month', OrderDate) = DATE '1999-06-01') AS BIGINT) AS r FROM sales) x""",
)
def _(t: Tables):
    total = full_forecast(t).agg(F.sum("Future_Forecast").alias("total"))
    return _rounded(inventory.growth_summary(total, t.sales, "1996-08-15", "1999-06-01"), ("growth_vs_base", "momentum"))


@query(
    "next_month_projection",
    """SELECT SubcategoryName, p AS Predicted_Sales, round(p * 1.04, 1) AS Next_Forecast, CAST(round_even(p * 1.04 + 1.65 * (SELECT avg(rmse) FROM bt), 0) AS BIGINT) AS Safe_Stock_Level FROM bt""",
)
def _(t: Tables):
    df = clean.trailing_days(naive_scores(t), "OrderDate", 29)
    error = F.sqrt(F.avg((F.col("actual") - F.col("pred")) * (F.col("actual") - F.col("pred"))))
    sums = df.groupBy(ITEM).agg(F.sum("pred").alias("Predicted_Sales"), error.alias("rmse"))
    out = inventory.next_month_projection(sums, sums.agg(F.avg("rmse")).scalar())
    return out.select(ITEM, "Predicted_Sales", F.round(F.col("Predicted_Sales") * 1.04, 1).alias("Next_Forecast"), "Safe_Stock_Level")


@query(
    "tiered_stock",
    """SELECT SubcategoryName, Model, Predicted, CAST(round_even(CASE Model WHEN 'LSTM' THEN Predicted + 1.65 * 16.11 WHEN 'XGBOOST' THEN Predicted + 1.65 * 22 ELSE 5 END, 0) AS BIGINT) AS Safe_Stock
       FROM (SELECT SubcategoryName, CASE WHEN ZeroDays / TotalDays < 0.10 THEN 'LSTM' WHEN ZeroDays / TotalDays < 0.50 THEN 'XGBOOST' ELSE 'COLD_START' END AS Model, Total AS Predicted FROM metb) x""",
)
def _(t: Tables):
    routed = routing.route(routing.metrics(panel_b(t)), routing.RATIO_ONLY_POLICY, "Model")
    df = routed.select(ITEM, "Model", F.col("Total").alias("Predicted"))
    return inventory.tiered_stock(df, {"LSTM": 16.11, "XGBOOST": 22.0})


@query(
    "against_last_year",
    """SELECT f.SubcategoryName, f.m AS month, f.u AS forecast_units, coalesce(h.u, 0) AS last_year_units
       FROM (SELECT SubcategoryName, CAST(date_trunc('month', OrderDate) AS DATE) AS m, CAST(sum(OrderQuantity) AS BIGINT) AS u FROM dlyb GROUP BY 1, 2) f
       LEFT JOIN (SELECT SubcategoryName, CAST(date_trunc('month', OrderDate) AS DATE) AS m, CAST(sum(OrderQuantity) AS BIGINT) AS u FROM sales JOIN word_items USING (ProductKey) GROUP BY 1, 2) h
         ON h.SubcategoryName = f.SubcategoryName AND h.m = f.m - INTERVAL 12 MONTH""",
)
def _(t: Tables):
    history = joins.daily_by_item(t.sales, t.word_items, "OrderDate", ["OrderQuantity"])
    ahead = daily_b(t).select(ITEM, F.col("OrderDate").alias("date"), F.col("OrderQuantity").alias("qty"))
    return inventory.against_last_year(ahead, history)


# --- boosted demand model --------------------------------------------------

MODEL_FEATURES = [
    "Subcategory_Encoded", "month", "dayofweek", "dayofyear", "is_weekend", "is_holiday", "lag_1", "lag_7",
    "rolling_median_7", "moving_std_7", "acceleration", "cat_weekend_inter",
]


@query("boosted_model_search")
def _(t: Tables):
    blocks = written(panels.time_blocks(panels.feature_table(written(panel_a(t))), 3))
    return evaluate.cross_validate(blocks, MODEL_FEATURES, "OrderQuantity", [{"maxDepth": 3}, {"maxDepth": 4}])


@query("poisson_model_search")
def _(t: Tables):
    blocks = written(panels.time_blocks(panels.feature_table(written(panel_a(t)), log_target=False), 3))
    return evaluate.cross_validate(blocks, MODEL_FEATURES, "OrderQuantity", [{"regParam": 0.0}, {"regParam": 0.1}], "poisson", False)


# Each fold is fitted apart, on its own rows, and scored row by row.
FOLD_FEATURES, FOLD_RIDGES = ["one", "is_weekend", "lag_1", "lag_7"], (0.0, 10.0)
PARTS["foldx"] = """SELECT i, n, CAST(OrderQuantity AS DOUBLE) AS y, [1.0::DOUBLE, CASE WHEN isodow(OrderDate) >= 6 THEN 1.0 ELSE 0.0 END,
      CAST(coalesce(lag(OrderQuantity, 1) OVER w, 0) AS DOUBLE), CAST(coalesce(lag(OrderQuantity, 7) OVER w, 0) AS DOUBLE)] AS x
    FROM numbered WINDOW w AS (PARTITION BY SubcategoryName ORDER BY OrderDate)"""
PARTS["foldrows"] = """SELECT fold, x, y, i < n - (n // 6) * (6 - fold) AS train
    FROM foldx, (SELECT unnest(generate_series(1, 5)) AS fold) f WHERE i < n - (n // 6) * (5 - fold)"""
PARTS["foldaug"] = """SELECT fold, ridge, list(row ORDER BY i) AS m FROM (SELECT fold, ridge, i, list_append(list(g ORDER BY j), any_value(b)) AS row FROM (
      SELECT fold, ridge, i, j, g + CASE WHEN i = j THEN ridge ELSE 0.0 END AS g, b FROM (
        SELECT fold, i, j, sum(x[i] * x[j]) AS g, sum(x[i] * y) AS b FROM foldrows, (SELECT unnest(range(1, 5)) AS i) a, (SELECT unnest(range(1, 5)) AS j) c
        WHERE train GROUP BY 1, 2, 3) s, (SELECT unnest([0.0::DOUBLE, 10.0::DOUBLE]) AS ridge) r) t GROUP BY 1, 2, 3) u GROUP BY 1, 2"""
PARTS["foldsolved"] = solved("foldaug", "fold, ridge")


@query(
    "expanding_fits",
    """SELECT s.fold, ridge, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_test,
         round(any_value(m[1][5]), 6) AS one, round(any_value(m[2][5]), 6) AS is_weekend, round(any_value(m[3][5]), 6) AS lag_1, round(any_value(m[4][5]), 6) AS lag_7,
         round(sqrt(avg(power(y - x[1] * m[1][5] - x[2] * m[2][5] - x[3] * m[3][5] - x[4] * m[4][5], 2)) FILTER (WHERE NOT train)), 6) AS rmse
       FROM foldrows r JOIN foldsolved s ON r.fold = s.fold GROUP BY 1, 2""",
)
def _(t: Tables):
    table = panels.feature_table(written(panel_a(t)), log_target=False).withColumn("one", F.lit(1.0))
    fits = evaluate.expanding_fits(panels.time_blocks(table, 5), FOLD_FEATURES, "OrderQuantity", FOLD_RIDGES)
    named = [F.get("coefficients", F.lit(i)).alias(f) for i, f in enumerate(FOLD_FEATURES)]
    return _rounded(fits.select("fold", "ridge", "n_train", "n_test", *named, "rmse"), (*FOLD_FEATURES, "rmse"))


@query("feature_importance")
def _(t: Tables):
    df = written(panels.feature_table(written(panel_a(t))))
    model = evaluate.demand_model(df, MODEL_FEATURES, "OrderQuantity")
    return evaluate.feature_importance(model, MODEL_FEATURES, t.spark)


@query("permutation_importance")
def _(t: Tables):
    df = written(panels.feature_table(written(panel_a(t))))
    model = evaluate.demand_model(df, MODEL_FEATURES, "OrderQuantity")
    return evaluate.permutation_importance(model, df, MODEL_FEATURES, "OrderQuantity")


# --- descriptive tables on the daily series --------------------------------

PARTS["dtot"] = """SELECT g.day, CAST(coalesce(u, 0) AS BIGINT) AS units FROM (SELECT CAST(unnest(generate_series(min(OrderDate), max(OrderDate), INTERVAL 1 DAY)) AS DATE) AS day FROM sales) g
    LEFT JOIN (SELECT OrderDate AS day, sum(OrderQuantity) AS u FROM sales GROUP BY 1) s USING (day)"""


@query("daily_total", "SELECT * FROM dtot")
def _(t: Tables):
    return profile.daily_total(t.sales)


@query("daily_total_mean", "SELECT round(avg(units), 6) AS mean_units FROM dtot")
def _(t: Tables):
    return profile.daily_total(t.sales).agg(F.round(F.avg("units"), 6).alias("mean_units"))


@query("monthly_total", "SELECT CAST(date_trunc('month', OrderDate) AS DATE) AS month, CAST(sum(OrderQuantity) AS BIGINT) AS units FROM sales GROUP BY 1")
def _(t: Tables):
    return profile.monthly(t.sales, "OrderDate", "OrderQuantity")


@query("iqr_outliers", "SELECT q3 + 1.5 * (q3 - q1) AS upper_band, (SELECT count(*) FROM pnl WHERE OrderQuantity > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT quantile_cont(OrderQuantity, 0.25) AS q1, quantile_cont(OrderQuantity, 0.75) AS q3 FROM pnl) q")
def _(t: Tables):
    return profile.iqr_outliers(panel_a(t), "OrderQuantity")


@query("deviation_bands", "SELECT day, units, units > m + 1.5 * s AS critical_high, units < m - 1.2 * s AS critical_low FROM dtot, (SELECT avg(units) AS m, stddev_samp(units) AS s FROM dtot) x")
def _(t: Tables):
    return profile.deviation_bands(profile.daily_total(t.sales))


@query("last_month_days", "SELECT day, units, isodow(day) >= 6 AS is_weekend, day > (SELECT max(day) - 7 FROM dtot) AS in_last_week FROM dtot WHERE date_trunc('month', day) = (SELECT date_trunc('month', max(day)) FROM dtot)")
def _(t: Tables):
    return profile.last_month_days(profile.daily_total(t.sales))


@query("last_week_days", "SELECT day, units, isodow(day) >= 6 AS is_weekend FROM dtot ORDER BY day DESC LIMIT 7")
def _(t: Tables):
    return profile.last_week_days(profile.daily_total(t.sales))


def item_lines(t: Tables) -> DataFrame:
    return joins.daily_by_item(t.sales, items_a(t), "OrderDate", ["OrderQuantity"])


def matrix(t: Tables) -> DataFrame:
    df = item_lines(t)
    return profile.monthly_matrix(df, ordering.top_groups(df, ITEM, "OrderQuantity", 10), ITEM, "OrderDate", "OrderQuantity")


PARTS["top10"] = "SELECT SubcategoryName FROM rsold GROUP BY 1 ORDER BY sum(OrderQuantity) DESC, 1 LIMIT 10"
PARTS["mx"] = """SELECT m.month, i.SubcategoryName, CAST(coalesce(u, 0) AS DOUBLE) AS units FROM (SELECT DISTINCT CAST(date_trunc('month', OrderDate) AS DATE) AS month FROM rsold WHERE SubcategoryName IN (SELECT * FROM top10)) m
    CROSS JOIN top10 i LEFT JOIN (SELECT CAST(date_trunc('month', OrderDate) AS DATE) AS month, SubcategoryName, sum(OrderQuantity) AS u FROM rsold GROUP BY 1, 2) s USING (month, SubcategoryName)"""


@query("monthly_item_matrix", "SELECT * FROM mx")
def _(t: Tables):
    return matrix(t)


@query("item_correlation", "SELECT a.SubcategoryName AS item_a, b.SubcategoryName AS item_b, round(corr(a.units, b.units), 6) AS correlation FROM mx a JOIN mx b USING (month) GROUP BY 1, 2")
def _(t: Tables):
    return _rounded(profile.correlation_matrix(matrix(t), ITEM, "units"), ("correlation",))


PARTS["mxg"] = "SELECT * FROM (SELECT month, SubcategoryName, units / nullif(lag(units) OVER (PARTITION BY SubcategoryName ORDER BY month), 0) - 1 AS g FROM mx) x WHERE g IS NOT NULL"


@query("pct_change", "SELECT month, SubcategoryName, round(g, 6) AS change FROM mxg")
def _(t: Tables):
    df = profile.pct_change(matrix(t), [ITEM], "month", "units").filter(F.col("change").isNotNull())
    return df.select("month", ITEM, F.round("change", 6).alias("change"))


@query("growth_correlation", "SELECT a.SubcategoryName AS item_a, b.SubcategoryName AS item_b, round(corr(a.g, b.g), 6) AS correlation FROM mxg a JOIN mxg b USING (month) GROUP BY 1, 2")
def _(t: Tables):
    df = profile.pct_change(matrix(t), [ITEM], "month", "units").filter(F.col("change").isNotNull())
    return _rounded(profile.correlation_matrix(df, ITEM, "change"), ("correlation",))


@query(
    "autocorrelation",
    """SELECT CAST(lag AS INT) AS lag, round(sum((a.units - m) * (b.units - m)) / (SELECT sum(power(units - (SELECT avg(units) FROM dtot), 2)) FROM dtot), 6) AS acf
       FROM dtot a CROSS JOIN (SELECT unnest(generate_series(0, 60)) AS lag) l JOIN dtot b ON b.day = a.day + CAST(lag AS INT) CROSS JOIN (SELECT avg(units) AS m FROM dtot) x GROUP BY 1""",
)
def _(t: Tables):
    return _rounded(profile.autocorrelation(profile.daily_total(t.sales), 60), ("acf",))


PARTS["acf30"] = """SELECT list(acf ORDER BY lag) AS r FROM (
      SELECT lag, sum((a.units - m) * (b.units - m)) / (SELECT sum(power(units - (SELECT avg(units) FROM dtot), 2)) FROM dtot) AS acf
      FROM dtot a CROSS JOIN (SELECT unnest(generate_series(0, 30)) AS lag) l JOIN dtot b ON b.day = a.day + CAST(lag AS INT) CROSS JOIN (SELECT avg(units) AS m FROM dtot) x GROUP BY 1) y"""


@query(
    "partial_autocorrelation",
    """SELECT CAST(k AS INT) AS lag, round(v, 6) AS pacf FROM (
         WITH RECURSIVE walk AS (
           SELECT 1 AS k, [r[2]] AS phi, r[2] AS v FROM acf30
           UNION ALL
           SELECT k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - new * phi[k + 1 - j]), [new]), new FROM (
             SELECT k, phi, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                          / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS new
             FROM walk CROSS JOIN acf30 WHERE k < 30) s)
         SELECT k, v FROM walk) p""",
)
def _(t: Tables):
    acf = profile.autocorrelation(written(profile.daily_total(t.sales)), 30)
    return _rounded(profile.partial_autocorrelation(acf, 30), ("pacf",))


PARTS["evts"] = "SELECT 'Payday ' || strftime(max(OrderDate), '%Y-%m') AS event, max(OrderDate) AS event_day FROM sales WHERE year(OrderDate) = 2000 GROUP BY month(OrderDate)"
PARTS["ewin"] = """SELECT event, 'event' AS kind, event_day - 3 AS a, event_day + 3 AS b FROM evts UNION ALL SELECT event, 'before', event_day - 10, event_day - 4 FROM evts"""
PARTS["d2000"] = "SELECT * FROM dtot WHERE year(day) = 2000"


@query(
    "event_windows",
    """SELECT event, kind, round(avg(units), 6) AS mean_units, median(units) AS median_units FROM d2000 JOIN ewin ON day BETWEEN a AND b GROUP BY 1, 2
       UNION ALL SELECT 'Normal Days', 'normal', round(avg(units), 6), median(units) FROM d2000 d WHERE NOT EXISTS (SELECT 1 FROM ewin WHERE d.day BETWEEN a AND b)""",
)
def _(t: Tables):
    daily = profile.daily_total(t.sales).filter(F.year("day") == 2000)
    paydays = t.sales.filter(F.year("OrderDate") == 2000).groupBy(F.month("OrderDate")).agg(F.max("OrderDate").alias("event_day"))
    events = paydays.select(F.concat(F.lit("Payday "), F.date_format("event_day", "yyyy-MM")).alias("event"), "event_day")
    return _rounded(profile.event_windows(daily, events), ("mean_units",))


@query("sparsity", "SELECT 'Zero Sales Days' AS metric, count(*) FILTER (WHERE OrderQuantity = 0) AS records, round(100 * count(*) FILTER (WHERE OrderQuantity = 0) / count(*), 6) AS percentage FROM pnlb UNION ALL SELECT 'Positive Sales Days', count(*) FILTER (WHERE OrderQuantity > 0), round(100 * count(*) FILTER (WHERE OrderQuantity > 0) / count(*), 6) FROM pnlb")
def _(t: Tables):
    return _rounded(profile.sparsity(panel_b(t), "OrderQuantity"), ("percentage",))
