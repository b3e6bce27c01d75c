"""Marketing, baskets, customers and pricing over the bound views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.operators import basket, clean, customer, impute, joins, lifetime, marketing, pricing, regress
from tillwise.plans import value
from tillwise.session import cut_lineage
from workloads import forecasting  # noqa: F401  defines oracle fragments used below
from workloads.registry import PARTS, Tables, query, solved

RATES = marketing.CARRY_OVER
# Plain weights of the five channels for queries that take weights as given.
WEIGHTS = {"tv_s": 0.9013, "ooh_s": 0.5017, "print_s": 0.2011, "facebook_s": 1.7519, "search_s": 0.0523}


def _rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- marketing -------------------------------------------------------------


def spend(t: Tables) -> DataFrame:
    return marketing.dense_weeks(t.weekly_spend)


def weights(t: Tables) -> DataFrame:
    """Given weights per channel seen in the data."""
    found = t.weekly_spend.select("channel").distinct()
    return found.withColumn("weight", marketing._by_channel(F.col("channel"), WEIGHTS))


def wide(t: Tables) -> DataFrame:
    s = spend(t).groupBy("date").pivot("channel", list(marketing.CHANNELS)).agg(F.sum("spend"))
    return t.weekly_profit.join(s, "date")


PARTS["wk"] = "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM weekly_spend"
PARTS["sp"] = """SELECT w.date, c.channel, coalesce(s.spend, 0) AS spend FROM wk w CROSS JOIN (SELECT DISTINCT channel FROM weekly_spend) c
    LEFT JOIN weekly_spend s ON s.date = w.date AND s.channel = c.channel"""
PARTS["rt"] = "SELECT * FROM (VALUES ('tv_s', 0.7::DOUBLE, 0.9013::DOUBLE), ('ooh_s', 0.5, 0.5017), ('print_s', 0.6, 0.2011), ('facebook_s', 0.3, 1.7519), ('search_s', 0.2, 0.0523)) v(channel, a, weight)"
PARTS["ads"] = """SELECT x.date, x.channel, x.spend, sum(y.spend * power(a, date_diff('day', y.date, x.date) // 7)) AS adstock
    FROM sp x JOIN sp y ON x.channel = y.channel AND y.date <= x.date JOIN rt ON rt.channel = x.channel GROUP BY 1, 2, 3"""


@query("dense_weeks", "SELECT date, channel, round(spend, 2) AS spend FROM sp")
def _(t: Tables):
    return _rounded(spend(t), ("spend",), 2)


@query("adstock", "SELECT date, channel, round(spend, 2) AS spend, round(adstock, 2) AS adstock FROM ads")
def _(t: Tables):
    return _rounded(marketing.adstock(spend(t), RATES), ("spend", "adstock"), 2)


@query(
    "marketing_feature_table",
    """SELECT p.date, round(p.profit, 4) AS profit, round(max(adstock) FILTER (WHERE channel = 'tv_s'), 2) AS tv_s, round(max(adstock) FILTER (WHERE channel = 'ooh_s'), 2) AS ooh_s,
              round(max(adstock) FILTER (WHERE channel = 'print_s'), 2) AS print_s, round(max(adstock) FILTER (WHERE channel = 'facebook_s'), 2) AS facebook_s,
              round(max(adstock) FILTER (WHERE channel = 'search_s'), 2) AS search_s
       FROM ads JOIN weekly_profit p ON ads.date = p.date GROUP BY p.date, p.profit""",
)
def _(t: Tables):
    # Weeks without any spend or profit row still decay, so the operator sees the dense series.
    weekly = spend(t).groupBy("date").pivot("channel", list(marketing.CHANNELS)).agg(F.sum("spend"))
    table = marketing.feature_table(weekly.join(t.weekly_profit, "date", "left"), RATES)
    return _rounded(_rounded(table.filter("profit IS NOT NULL"), marketing.CHANNELS, 2), ("profit",), 4)


@query("trend_features", "SELECT date, year(date) AS year, month(date) AS month, dayofyear(date) AS dayofyear, row_number() OVER (ORDER BY date) - 1 AS trend FROM weekly_profit")
def _(t: Tables):
    return marketing.trend_features(t.weekly_profit).drop("profit")


@query(
    "spend_shares",
    """SELECT channel, round(s, 2) AS spend, round(s / sum(s) OVER (), 6) AS share, round(s / sum(s) OVER () * count(*) OVER () / sqrt(1 - 2 / pi()), 6) AS prior_sigma
       FROM (SELECT channel, sum(spend) AS s FROM sp GROUP BY 1) x""",
)
def _(t: Tables):
    df = _rounded(marketing.spend_shares(spend(t)), ("share", "prior_sigma"), 6)
    return _rounded(df, ("spend",), 2)


@query("revenue_per_spend", "SELECT round(r, 2) AS revenue, round(s, 2) AS spend, round(r / s, 6) AS revenue_per_spend FROM (SELECT sum(profit) AS r FROM weekly_profit) a, (SELECT sum(spend) AS s FROM weekly_spend) b")
def _(t: Tables):
    df = marketing.revenue_per_spend(t.weekly_spend, t.weekly_profit)
    return df.select(F.round("revenue", 2).alias("revenue"), F.round("spend", 2).alias("spend"), F.round("revenue_per_spend", 6).alias("revenue_per_spend"))


for _name, _use in (("roi_table", "adstock"), ("roi_table_unadjusted", "spend")):

    @query(
        _name,
        f"""SELECT a.channel, round_even(sum(spend), 2) AS total_spend, round_even(sum({_use}) * weight, 2) AS contribution, round_even(weight, 2) AS weight,
                   round_even(sum({_use}) * weight / sum(spend), 2) AS roi FROM ads a JOIN rt ON rt.channel = a.channel GROUP BY a.channel, weight""",
    )
    def _(t: Tables, use: str = _use):
        return marketing.roi_table(marketing.adstock(spend(t), RATES), weights(t), use)


@query(
    "waterfall",
    """SELECT channel, round(v, 2) AS value, CAST(pos AS INT) AS position, round(coalesce(sum(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS bottom,
              round(sum(v) OVER (ORDER BY pos), 2) AS top FROM (
         SELECT a.channel, sum(adstock) * weight AS v, CASE a.channel WHEN 'tv_s' THEN 2 WHEN 'ooh_s' THEN 3 WHEN 'print_s' THEN 4 WHEN 'facebook_s' THEN 5 ELSE 6 END AS pos
         FROM ads a JOIN rt ON rt.channel = a.channel GROUP BY a.channel, weight
         UNION ALL SELECT 'Baseline (Organic)', (SELECT sum(profit) FROM weekly_profit) - (SELECT sum(adstock * weight) FROM ads JOIN rt ON rt.channel = ads.channel), 1) x""",
)
def _(t: Tables):
    total = t.weekly_profit.agg(F.sum("profit")).scalar()
    df = marketing.waterfall(marketing.adstock(spend(t), RATES), weights(t), total, marketing.CHANNELS)
    return _rounded(df, ("value", "bottom", "top"), 2)


@query("channel_contributions", "SELECT date, s.channel, round(spend, 2) AS spend, round(spend * weight, 6) AS contribution FROM sp s JOIN rt ON rt.channel = s.channel")
def _(t: Tables):
    df = marketing.contributions(spend(t), weights(t))
    return _rounded(_rounded(df, ("spend",), 2), ("contribution",), 6)


@query("roas", "SELECT s.channel, round(sum(adstock * weight) / sum(spend), 6) AS roas FROM ads s JOIN rt ON rt.channel = s.channel GROUP BY 1")
def _(t: Tables):
    df = marketing.contributions(marketing.adstock(spend(t), RATES), weights(t), "adstock")
    return _rounded(marketing.roas(df), ("roas",), 6)


PARTS["bud"] = "SELECT market, round(sum(spend) / 1000, 0) AS budget FROM market_spend GROUP BY 1"


@query(
    "budget_strategies",
    """SELECT market, budget, channel, round(allocation, 2) AS allocation, roi, round(allocation * roi, 3) AS expected_profit FROM (
         SELECT market, budget, v.channel, v.roi, CASE v.channel WHEN 'facebook_s' THEN budget * l WHEN 'tv_s' THEN budget - budget * l - 3 * (budget * 0.05) ELSE budget * 0.05 END AS allocation
         FROM (SELECT *, CASE WHEN budget <= 15000 THEN 0.55 ELSE 0.50 END AS l FROM bud) b
         CROSS JOIN (VALUES ('facebook_s', 1.77::DOUBLE), ('tv_s', 0.9), ('ooh_s', 0.54), ('print_s', 0.21), ('search_s', 0.04)) v(channel, roi)) x""",
)
def _(t: Tables):
    budgets = t.market_spend.groupBy("market").agg(F.round(F.sum("spend") / 1000, 0).alias("budget"))
    df = marketing.budget_strategies(budgets)
    return _rounded(_rounded(df, ("allocation",), 2), ("expected_profit",), 3)


PARTS["scen"] = """SELECT m.market, m.channel, b.budget, rt.weight * (1 + 0.1 * (m.market % 3)) AS weight FROM (SELECT DISTINCT market, channel FROM market_spend) m
    JOIN bud b USING (market) JOIN rt ON rt.channel = m.channel"""


@query(
    "best_allocation",
    """SELECT market, channel, n * 0.05 <= 1 AND n * 0.5 >= 1 AS feasible, CASE WHEN n * 0.05 <= 1 AND n * 0.5 >= 1 THEN
              round(budget * 0.05 + least(greatest(budget - budget * 0.05 * n - budget * 0.45 * (r - 1), 0), budget * 0.45), 2) END AS allocation
       FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY weight DESC, channel) AS r, count(*) OVER (PARTITION BY market) AS n FROM scen) x""",
)
def _(t: Tables):
    budgets = t.market_spend.groupBy("market").agg(F.round(F.sum("spend") / 1000, 0).alias("budget"))
    scenarios = t.market_spend.select("market", "channel").distinct().join(budgets, "market").join(weights(t), "channel")
    scenarios = scenarios.withColumn("weight", F.col("weight") * (F.lit(1) + F.lit(0.1) * (F.col("market") % 3)))
    return _rounded(marketing.best_allocation(scenarios, ["market"]), ("allocation",), 2).select("market", "channel", "feasible", "allocation")


_RESP = {"linear": "weight * g", "log": "ln(1 + g) * (weight * 1000)", "saturating": "(weight * 1200) * ln(1 + g / 100)"}
for _form, _sql in _RESP.items():

    @query(
        f"response_curve_{_form}",
        f"""SELECT channel, CAST(p AS INT) AS point, round(g, 7) AS grid_spend, round({_sql}, 7) AS response FROM (
              SELECT s.channel, weight, p, max(spend) * 1.5 * p / 99.0 AS g FROM sp s JOIN rt ON rt.channel = s.channel, (SELECT unnest(generate_series(0, 99)) AS p) q GROUP BY 1, 2, 3) x""",
    )
    def _(t: Tables, form: str = _form):
        return _rounded(marketing.response_curves(spend(t), weights(t), form), ("grid_spend", "response"), 7)


_CH = ("tv_s", "ooh_s", "print_s", "facebook_s", "search_s")
PARTS["mtab"] = "SELECT p.date, p.profit, " + ", ".join(f"max(adstock) FILTER (WHERE channel = '{c}') AS {c}" for c in _CH) + " FROM ads JOIN weekly_profit p ON ads.date = p.date GROUP BY p.date, p.profit"
PARTS["mdesign"] = f"""SELECT date, profit, [1.0::DOUBLE, t, sin(t * 2 * pi() / 12), cos(t * 2 * pi() / 12), {", ".join(_CH)}] AS x
    FROM (SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS DOUBLE) AS t FROM mtab) y"""
PARTS["maug"] = """SELECT list(row ORDER BY i) AS m FROM (SELECT i, list_append(list(g ORDER BY j), any_value(b)) AS row FROM (
      SELECT i, j, sum(x[i] * x[j]) AS g, sum(x[i] * profit) AS b FROM mdesign, (SELECT unnest(range(1, 10)) AS i) a, (SELECT unnest(range(1, 10)) AS j) c GROUP BY i, j) s GROUP BY i) r"""
PARTS["msolved"] = solved("maug")
PARTS["vaug"] = f"""SELECT list(row ORDER BY i) AS m FROM (SELECT i, list_concat(list(g ORDER BY j), list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j)) AS row FROM (
      SELECT i, j, sum(x[i] * x[j]) AS g FROM (SELECT [{", ".join(_CH)}] AS x FROM mtab) z, (SELECT unnest(range(1, 6)) AS i) a, (SELECT unnest(range(1, 6)) AS j) c GROUP BY i, j) s GROUP BY i) r"""
PARTS["vsolved"] = solved("vaug")


def _digits(df: DataFrame, columns, digits: int = 5) -> DataFrame:
    """Numbers as text with so many significant digits; fits are compared by them."""
    return df.withColumns({c: F.format_string(f"%.{digits - 1}e", F.col(c)) for c in columns})


@query(
    "marketing_weights",
    """SELECT f AS feature, format('{:.4e}', m[i][10]) AS coefficient FROM msolved,
         (SELECT unnest(range(1, 10)) AS i, unnest(['one', 'trend', 'season_sin', 'season_cos', 'tv_s', 'ooh_s', 'print_s', 'facebook_s', 'search_s']) AS f) n""",
)
def _(t: Tables):
    return _digits(marketing.fit_weights(marketing_table(t)), ("coefficient",))


def marketing_table(t: Tables) -> DataFrame:
    carried = marketing.adstock(spend(t), RATES)
    table = carried.groupBy("date").pivot("channel", list(marketing.CHANNELS)).agg(F.sum("adstock"))
    return cut_lineage(t.weekly_profit.join(table, "date"))


@query(
    "marketing_fit",
    """SELECT date, round(profit, 4) AS actual, format('{:.4e}', list_sum(list_transform(range(1, 10), lambda i: x[i] * m[i][10]))) AS pred FROM mdesign, msolved""",
)
def _(t: Tables):
    table = marketing_table(t)
    fitted = marketing.predict(table, cut_lineage(marketing.fit_weights(table)))
    return _digits(fitted.select("date", F.round("profit", 4).alias("actual"), "pred"), ("pred",))


@query(
    "variance_inflation",
    """SELECT f AS feature, format('{:.4e}', g.m[i][i] * s.m[i][5 + i]) AS vif FROM vaug g, vsolved s,
         (SELECT unnest(range(1, 6)) AS i, unnest(['tv_s', 'ooh_s', 'print_s', 'facebook_s', 'search_s']) AS f) n""",
)
def _(t: Tables):
    return _digits(regress.vif(marketing_table(t), list(marketing.CHANNELS)), ("vif",))


@query(
    "grouped_line_fit",
    """SELECT CategoryName, event, round(regr_intercept(profit, OrderQuantity), 3) AS intercept, round(regr_slope(profit, OrderQuantity), 3) AS slope, count(*) AS n
       FROM price_events GROUP BY 1, 2""",
)
def _(t: Tables):
    return _rounded(regress.simple_line(t.price_events, ["CategoryName", "event"], "OrderQuantity", "profit"), ("intercept", "slope"), 3)


# --- baskets ---------------------------------------------------------------


def item_lines(t: Tables) -> DataFrame:
    return joins.enrich_sales(t.sales.select("OrderNumber", "ProductKey"), t.products, t.subcategories)


def item_sets(t: Tables) -> DataFrame:
    return basket.frequent_itemsets(basket.baskets(item_lines(t), min_support=0.01), 0.01)


PARTS["bl"] = "SELECT DISTINCT OrderNumber, SubcategoryName FROM sales JOIN pitems USING (ProductKey) WHERE SubcategoryName IS NOT NULL"
PARTS["nb"] = "SELECT count(DISTINCT OrderNumber) AS n FROM bl"
PARTS["fs"] = """SELECT SubcategoryName AS items, 1 AS size, count(*) AS freq, count(*) / (SELECT n FROM nb) AS support FROM bl GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT n FROM nb)
    UNION ALL SELECT a.SubcategoryName || ',' || b.SubcategoryName, 2, count(*), count(*) / (SELECT n FROM nb) FROM bl a JOIN bl b ON a.OrderNumber = b.OrderNumber AND a.SubcategoryName < b.SubcategoryName
      GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT n FROM nb)
    UNION ALL SELECT a.SubcategoryName || ',' || b.SubcategoryName || ',' || c.SubcategoryName, 3, count(*), count(*) / (SELECT n FROM nb) FROM bl a JOIN bl b ON a.OrderNumber = b.OrderNumber AND a.SubcategoryName < b.SubcategoryName
      JOIN bl c ON b.OrderNumber = c.OrderNumber AND b.SubcategoryName < c.SubcategoryName GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT n FROM nb)"""
PARTS["fl"] = "SELECT *, string_split(items, ',') AS l FROM fs"
PARTS["ra"] = "SELECT p.items AS itemset, p.l AS pl, p.size AS psize, p.support AS s, a.items AS ant, a.l AS al, a.size AS asize, a.support AS sa FROM fl p JOIN fl a ON a.size < p.size AND list_has_all(p.l, a.l)"
PARTS["rl"] = """SELECT itemset, ant, c.items AS con, sa, c.support AS sc, s, s / sa AS confidence, s / sa / c.support AS lift
    FROM ra JOIN fl c ON c.size = psize - asize AND list_has_all(pl, c.l) AND NOT list_has_any(al, c.l)"""


@query("baskets", "SELECT OrderNumber, string_agg(SubcategoryName, ',' ORDER BY SubcategoryName) AS items FROM bl GROUP BY 1")
def _(t: Tables):
    return basket.baskets(item_lines(t)).select("OrderNumber", F.array_join("items", ",").alias("items"))


@query("frequent_itemsets", "SELECT items, size, freq, round(support, 8) AS support FROM fs")
def _(t: Tables):
    return item_sets(t).select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"), "freq", F.round("support", 8).alias("support"))


@query("top_pairs", "SELECT items, round(support, 8) AS support FROM fs WHERE size = 2 ORDER BY fs.support DESC, items LIMIT 10")
def _(t: Tables):
    return basket.of_size(item_sets(t), 2, 10).select(F.array_join("items", ",").alias("items"), F.round("support", 8).alias("support"))


@query("pair_matrix", "SELECT split_part(items, ',', 1) AS item1, split_part(items, ',', 2) AS item2, round(support, 8) AS support FROM fs WHERE size = 2")
def _(t: Tables):
    return _rounded(basket.pair_matrix(item_sets(t)), ("support",), 8)


@query("association_rules", "SELECT ant, con, round(sa, 8) AS sa, round(sc, 8) AS sc, round(s, 8) AS s, round(confidence, 8) AS confidence, round(lift, 8) AS lift FROM rl WHERE lift >= 1")
def _(t: Tables):
    df = basket.rules(item_sets(t))
    return df.select(
        F.array_join("antecedents", ",").alias("ant"), F.array_join("consequents", ",").alias("con"), F.round("antecedent_support", 8).alias("sa"),
        F.round("consequent_support", 8).alias("sc"), F.round("support", 8).alias("s"), F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"),
    )


@query(
    "significant_rules",
    """SELECT replace(ant, ',', ', ') AS antecedents, replace(con, ',', ', ') AS consequents, round(confidence, 8) AS confidence, round(lift, 8) AS lift FROM (
         SELECT *, row_number() OVER (PARTITION BY itemset ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, ant) AS r FROM rl WHERE confidence > 0.05 AND lift > 0.9) x WHERE r = 1""",
)
def _(t: Tables):
    df = basket.significant_rules(basket.rules(item_sets(t), 0.0, 0.05), 0.05, 0.9, digits=None)
    return df.select("antecedents", "consequents", F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"))


@query(
    "basket_plan",
    """SELECT replace(ant, ',', ', ') AS antecedents, replace(con, ',', ', ') AS consequents, round_even(sa, 2) AS antecedent_support, round_even(sc, 2) AS consequent_support,
              round_even(s, 2) AS support, round_even(confidence, 2) AS confidence, round_even(lift, 2) AS lift FROM (
         SELECT *, row_number() OVER (PARTITION BY itemset ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, ant) AS r FROM rl WHERE confidence > 0.04 AND lift > 1) x WHERE r = 1""",
)
def _(t: Tables):
    return value.basket_plan(t.sales, t.products, t.subcategories, min_confidence=0.04)["significant"]


# --- customers -------------------------------------------------------------


def history(t: Tables) -> DataFrame:
    return customer.transactions(t.sales, t.products)


def summary(t: Tables) -> DataFrame:
    return customer.purchase_summary(history(t))


PARTS["hist"] = "SELECT OrderDate, CustomerKey, (ProductPrice - ProductCost) * OrderQuantity AS Profit FROM sales JOIN products USING (ProductKey)"
_SUM = """SELECT CustomerKey, count(*) - 1 AS frequency, date_diff('day', min(OrderDate), max(OrderDate)) AS recency, date_diff('day', min(OrderDate), {end}) AS T,
    coalesce(avg(z) FILTER (WHERE k > 1), 0) AS monetary_value
    FROM (SELECT CustomerKey, OrderDate, sum(Profit) AS z, row_number() OVER (PARTITION BY CustomerKey ORDER BY OrderDate) AS k FROM hist {where} GROUP BY 1, 2) d GROUP BY 1"""
PARTS["rfm"] = _SUM.format(end="(SELECT max(OrderDate) FROM hist)", where="")
PARTS["rfmcal"] = _SUM.format(end="DATE '2000-12-31'", where="WHERE OrderDate <= DATE '2000-12-31'")
PARTS["flag"] = "SELECT *, frequency > 12 AS hf, monetary_value > 40000 AS hm FROM rfm WHERE frequency > 0"
PARTS["customer_names"] = "SELECT CustomerKey, LastName FROM raw_customers"
MANY, RICH = 12, 40000


@query("clv_transactions", "SELECT OrderDate, CustomerKey, round(Profit, 4) AS Profit FROM hist")
def _(t: Tables):
    return _rounded(history(t), ("Profit",))


@query("purchase_summary", "SELECT CustomerKey, frequency, recency, T, round(monetary_value, 6) AS monetary_value FROM rfm")
def _(t: Tables):
    return _rounded(summary(t), ("monetary_value",), 6)


@query(
    "calibration_summary",
    """SELECT c.CustomerKey, frequency AS frequency_cal, recency AS recency_cal, T AS T_cal, round(monetary_value, 6) AS monetary_value_cal, coalesce(f, 0) AS frequency_holdout,
              round(coalesce(m, 0), 6) AS monetary_value_holdout, 181 AS duration_holdout
       FROM rfmcal c LEFT JOIN (SELECT CustomerKey, count(DISTINCT OrderDate) AS f, avg(Profit) AS m FROM hist WHERE OrderDate > DATE '2000-12-31' AND OrderDate <= DATE '2001-06-30' GROUP BY 1) h USING (CustomerKey)""",
)
def _(t: Tables):
    df = customer.calibration_summary(history(t), "2000-12-31", "2001-06-30")
    return _rounded(df, ("monetary_value_cal", "monetary_value_holdout"), 6)


@query("outlier_groups", "SELECT CustomerKey, CASE WHEN hf OR hm THEN 'whale' ELSE 'core' END AS grp, hf AS high_freq, hm AS high_mon FROM flag")
def _(t: Tables):
    f = customer.with_outlier_flags(summary(t), MANY, RICH)
    return f.select("CustomerKey", F.when(F.col("high_freq") | F.col("high_mon"), "whale").otherwise("core").alias("grp"), "high_freq", "high_mon")


@query("repeat_buyers", "SELECT CustomerKey, frequency FROM rfm WHERE frequency > 0")
def _(t: Tables):
    return customer.repeat_buyers(summary(t)).select("CustomerKey", "frequency")


@query("outlier_counts", 'SELECT count(*) FILTER (WHERE hf AND hm) AS "both", count(*) FILTER (WHERE NOT hf AND hm) AS only_value, count(*) FILTER (WHERE hf AND NOT hm) AS only_frequency, count(*) FILTER (WHERE NOT hf AND NOT hm) AS core FROM flag')
def _(t: Tables):
    return customer.outlier_counts(summary(t), MANY, RICH)


@query("outlier_segments", "SELECT CustomerKey, CASE WHEN hf AND hm THEN 6 WHEN hf THEN 5 ELSE 4 END AS Segment FROM flag WHERE hf OR hm")
def _(t: Tables):
    return customer.outlier_segments(summary(t), MANY, RICH, "split").select("CustomerKey", "Segment")


@query("whale_customers", "SELECT * FROM customer_names WHERE CustomerKey IN (SELECT CustomerKey FROM flag WHERE hf OR hm)")
def _(t: Tables):
    names = t.raw_customers.select("CustomerKey", "LastName")
    return joins.keep_keys(names, customer.outlier_groups(summary(t), MANY, RICH)["whales"], ["CustomerKey"])


@query("core_customers", "SELECT * FROM customer_names WHERE CustomerKey NOT IN (SELECT CustomerKey FROM flag WHERE hf OR hm)")
def _(t: Tables):
    names = t.raw_customers.select("CustomerKey", "LastName")
    return joins.drop_keys(names, customer.outlier_groups(summary(t), MANY, RICH)["whales"], ["CustomerKey"])


@query(
    "purchase_probability",
    """SELECT CustomerKey, SubcategoryName, round(c / tot, 8) AS probability FROM (
         SELECT *, row_number() OVER (PARTITION BY CustomerKey ORDER BY c DESC, SubcategoryName) AS r FROM (
           SELECT CustomerKey, SubcategoryName, count(*) AS c, sum(count(*)) OVER (PARTITION BY CustomerKey) AS tot FROM sales LEFT JOIN pitems USING (ProductKey) GROUP BY 1, 2) x
         WHERE SubcategoryName IS NOT NULL) y WHERE r <= 3""",
)
def _(t: Tables):
    items = joins.product_items(t.products, t.subcategories)
    return _rounded(customer.purchase_probability(t.sales, items), ("probability",), 8)


FREQ = customer.FrequencyModel(1.8, 95.0, 0.6, 4.2)
SPEND = customer.SpendModel(2.4, 3.6, 21000.0)


@query(
    "alive_and_value",
    """SELECT CustomerKey, round(CASE WHEN frequency = 0 THEN 1 ELSE 1 / (1 + 0.6 / (4.2 + greatest(frequency, 1) - 1) * power((T + 95.0) / (recency + 95.0), 1.8 + frequency)) END, 8) AS prob_alive,
              round((1 - 2.4 * frequency / (2.4 * frequency + 2.6)) * (21000 * 2.4 / 2.6) + 2.4 * frequency / (2.4 * frequency + 2.6) * monetary_value, 3) AS exp_avg_profit FROM rfm""",
)
def _(t: Tables):
    return summary(t).select("CustomerKey", F.round(customer.alive_probability(FREQ), 8).alias("prob_alive"), F.round(customer.expected_value(SPEND), 3).alias("exp_avg_profit"))


@query(
    "expected_purchases",
    """SELECT CustomerKey, round((frequency + 3.8) / -0.4 * (1 - f * power((T + 95.0) / (T + 185.0), frequency + 1.8))
              / (1 + CASE WHEN frequency > 0 THEN 0.6 / (frequency + 3.2) * power((T + 95.0) / (recency + 95.0), frequency + 1.8) ELSE 0 END), 6) AS purchases
       FROM (SELECT CustomerKey, frequency, recency, T, 1 + sum(exp(l)) AS f FROM (
               SELECT r.*, n, sum(ln((frequency + 1.8 + n) * (frequency + 4.2 + n) / ((frequency + 3.8 + n) * (n + 1)) * (90.0 / (T + 185.0)))) OVER (PARTITION BY CustomerKey ORDER BY n) AS l
               FROM rfm r, (SELECT unnest(generate_series(0, 199)) AS n) g) x GROUP BY 1, 2, 3, 4) y""",
)
def _(t: Tables):
    return summary(t).select("CustomerKey", F.round(customer.expected_purchases(FREQ, 90), 6).alias("purchases"))


@query("lifetime_model_fit")
def _(t: Tables):
    s = cut_lineage(customer.outlier_groups(summary(t), MANY, RICH)["core"])
    return customer.model_table(t.spark, customer.fit_frequency_model(s), customer.fit_spend_model(s))


@query(
    "lifetime_equations",
    """SELECT 'frequency' AS model, count(*) AS customers, 0.0 AS gradient, true AS converged FROM flag WHERE NOT hf AND NOT hm
       UNION ALL SELECT 'spend', count(*), 0.0, true FROM flag WHERE NOT hf AND NOT hm AND monetary_value > 0""",
)
def _(t: Tables):
    core = cut_lineage(customer.outlier_groups(summary(t), MANY, RICH)["core"])
    frequency, spend = lifetime.fit_frequency_model(core), lifetime.fit_spend_model(core)
    facts = lifetime.model_equations(core, frequency, spend)
    ended = F.when(F.col("model") == "frequency", frequency.converged).otherwise(spend.converged)
    return _rounded(facts, ("gradient",), 5).withColumn("converged", ended)


PARTS["bought"] = """SELECT CustomerKey, d, (frequency + 3.8) / -0.4 * (1 - f * power((T + 95.0) / (T + 95.0 + d), frequency + 1.8))
      / (1 + 0.6 / (frequency + 3.2) * power((T + 95.0) / (recency + 95.0), frequency + 1.8)) AS b
    FROM (SELECT CustomerKey, frequency, recency, T, d, 1 + sum(exp(l)) AS f FROM (
        SELECT r.*, d, n, sum(ln((frequency + 1.8 + n) * (frequency + 4.2 + n) / ((frequency + 3.8 + n) * (n + 1)) * (d / (T + 95.0 + d)))) OVER (PARTITION BY CustomerKey, d ORDER BY n) AS l
        FROM (SELECT * FROM rfm WHERE frequency > 0) r, (SELECT unnest([30.0::DOUBLE, 60.0, 90.0]) AS d) h, (SELECT unnest(generate_series(0, 999)) AS n) g) x GROUP BY 1, 2, 3, 4, 5) y"""
PARTS["worth"] = """SELECT CustomerKey, max(b) FILTER (WHERE d = 30) AS b1, max(b) FILTER (WHERE d = 60) AS b2, max(b) FILTER (WHERE d = 90) AS b3 FROM bought GROUP BY 1"""


@query(
    "clv_scoring",
    """SELECT CustomerKey, frequency, round(pa, 8) AS prob_alive, round(b3, 6) AS pred_purchases_90d, round(v, 3) AS exp_avg_profit,
              round(v * (b1 / 1.01 + (b2 - b1) / power(1.01, 2) + (b3 - b2) / power(1.01, 3)), 2) AS CLV_90d
       FROM (SELECT r.*, w.b1, w.b2, w.b3, 1 / (1 + 0.6 / (4.2 + frequency - 1) * power((T + 95.0) / (recency + 95.0), 1.8 + frequency)) AS pa,
               (1 - 2.4 * frequency / (2.4 * frequency + 2.6)) * (21000 * 2.4 / 2.6) + 2.4 * frequency / (2.4 * frequency + 2.6) * monetary_value AS v
             FROM rfm r JOIN worth w USING (CustomerKey) WHERE frequency > 0) x""",
)
def _(t: Tables):
    scored = customer.score(customer.repeat_buyers(summary(t)), FREQ, SPEND)
    scored = _rounded(_rounded(scored, ("prob_alive",), 8), ("pred_purchases_90d",), 6)
    scored = _rounded(_rounded(scored, ("exp_avg_profit",), 3), ("CLV_90d",), 2)
    return scored.select("CustomerKey", "frequency", "prob_alive", "pred_purchases_90d", "exp_avg_profit", "CLV_90d")


@query("customer_segments")
def _(t: Tables):
    core = cut_lineage(customer.outlier_groups(summary(t), MANY, RICH)["core"])
    return customer.assign_segments(core, customer.fit_segments(core))


@query("segment_sweep")
def _(t: Tables):
    return customer.segment_sweep(cut_lineage(customer.outlier_groups(summary(t), MANY, RICH)["core"]))


@query("chained_imputation")
def _(t: Tables):
    groups = customer.outlier_groups(cut_lineage(summary(t)), MANY, RICH)
    scored = customer.score(groups["core"], FREQ, SPEND)
    return customer.impute_chained(customer.combine(scored, groups["whales"]))


_MODELLED = ("prob_alive", "pred_purchases_90d", "exp_avg_profit", "CLV_90d")


@query(
    "imputation_equations",
    "SELECT target, (SELECT count(*) FROM flag WHERE hf OR hm) AS filled, 0 AS changed, 0.0 AS misfit, 0.0 AS residual, true AS converged FROM (VALUES "
    + ", ".join(f"('{c}')" for c in _MODELLED) + ") AS x(target)",
)
def _(t: Tables):
    groups = customer.outlier_groups(cut_lineage(summary(t)), MANY, RICH)
    scored = customer.score(groups["core"], FREQ, SPEND)
    people = cut_lineage(customer.combine(scored, groups["whales"]))
    model = impute.fit_imputation(people, customer.IMPUTE_COLUMNS, rounds=2000, tol=1e-6)
    facts = impute.equation_check(people, model.apply(people), model, [customer.ID])
    return _rounded(_rounded(facts, ("misfit",), 2), ("residual",), 4).withColumn("converged", F.lit(model.converged))


@query("customer_value_plan")
def _(t: Tables):
    people = t.raw_customers.withColumn("BirthDate", F.try_to_date("BirthDate"))
    return value.customer_plan(t.sales, t.products, people, MANY, RICH)


# Segments by rule (frequency quartile-like bands) keep the next tables exact.
_SEG = "CASE WHEN frequency > 12 AND monetary_value > 20000 THEN 5 WHEN frequency > 12 THEN 4 WHEN frequency > 9 THEN 1 WHEN frequency > 6 THEN 3 WHEN monetary_value > 20000 THEN 2 ELSE 0 END"
PARTS["seg"] = f"SELECT r.*, {_SEG} AS Segment, monetary_value * frequency AS CLV_90d FROM rfm r WHERE frequency > 0"
PARTS["people"] = """SELECT s.*, MaritalStatus, TotalChildren, Occupation, EducationLevel, HomeOwner,
    CAST(floor(date_diff('day', CAST(BirthDate AS DATE), DATE '2017-08-01') / 365.0) AS INT) AS Age FROM seg s LEFT JOIN raw_customers USING (CustomerKey)"""


def segmented(t: Tables) -> DataFrame:
    s = customer.repeat_buyers(summary(t))
    return s.withColumn("Segment", F.expr(_SEG)).withColumn("CLV_90d", F.col("monetary_value") * F.col("frequency"))


def people(t: Tables) -> DataFrame:
    who = customer.demographics(t.raw_customers.withColumn("BirthDate", F.try_to_date("BirthDate")))
    return joins.look_up(segmented(t), who, ["CustomerKey"])


@query("financial_columns", "SELECT CustomerKey, round(CLV_90d * 0.1, 3) AS CLV_at_Risk, round(CLV_90d * 0.2, 3) AS Marketing_Budget_90d FROM seg")
def _(t: Tables):
    df = customer.financial_columns(segmented(t))
    return _rounded(df, ("CLV_at_Risk", "Marketing_Budget_90d"), 3).select("CustomerKey", "CLV_at_Risk", "Marketing_Budget_90d")


@query("risk_by_segment", "SELECT Segment, round(sum(CLV_90d), 2) AS CLV_90d, round(sum(CLV_90d) * 0.1, 3) AS CLV_at_Risk FROM seg GROUP BY 1")
def _(t: Tables):
    df = customer.risk_by_segment(customer.financial_columns(segmented(t)))
    return _rounded(_rounded(df, ("CLV_90d",), 2), ("CLV_at_Risk",), 3)


@query("segment_counts", "SELECT Segment, count(*) AS customers, round(avg(frequency), 6) AS mean_frequency, round(avg(recency), 6) AS mean_recency, round(avg(monetary_value), 3) AS mean_monetary_value FROM seg GROUP BY 1")
def _(t: Tables):
    df = customer.segment_counts(segmented(t))
    return _rounded(_rounded(df, ("mean_frequency", "mean_recency"), 6), ("mean_monetary_value",), 3)


@query(
    "segment_strategies",
    """SELECT CustomerKey, s.Segment, n AS segment_name FROM seg s JOIN (VALUES (4, 'High-Value Whales'), (5, 'Operational Whales'), (1, 'Elite Champions'),
         (3, 'Loyal Daily-Drivers'), (2, 'Slipping High-Spenders'), (0, 'Potential Growth')) v(Segment, n) ON v.Segment = s.Segment""",
)
def _(t: Tables):
    return customer.with_strategies(segmented(t)).select("CustomerKey", "Segment", "segment_name")


PARTS["prof"] = """SELECT Segment, median(frequency) AS frequency, median(recency) AS recency, median(CLV_90d) AS CLV_90d, median(Age) AS Age,
    avg(CASE WHEN MaritalStatus = 'M' THEN 1.0 ELSE 0 END) AS married, avg(CASE WHEN TotalChildren > 0 THEN 1.0 ELSE 0 END) AS parents,
    avg(CASE WHEN HomeOwner = 'Y' THEN 1.0 ELSE 0 END) AS owners FROM people GROUP BY 1"""
PARTS["occ"] = "SELECT Segment, Occupation FROM (SELECT Segment, Occupation, row_number() OVER (PARTITION BY Segment ORDER BY count(*) DESC, Occupation) AS r FROM people WHERE Occupation IS NOT NULL GROUP BY 1, 2) x WHERE r = 1"


def profiles(t: Tables) -> DataFrame:
    shares = {"married": F.col("MaritalStatus") == "M", "parents": F.col("TotalChildren") > 0, "owners": F.col("HomeOwner") == "Y"}
    return customer.segment_profile(people(t), ["frequency", "recency", "CLV_90d", "Age"], shares, ["Occupation"])


@query(
    "segment_profile",
    """SELECT p.Segment, frequency, recency, round(CLV_90d, 3) AS CLV_90d, Age, round(married, 6) AS married, round(parents, 6) AS parents, round(owners, 6) AS owners, Occupation
       FROM prof p JOIN occ o ON o.Segment = p.Segment""",
)
def _(t: Tables):
    return _rounded(_rounded(profiles(t), ("married", "parents", "owners"), 6), ("CLV_90d",), 3)


@query(
    "profile_overrides",
    """SELECT Segment, round(CASE Segment WHEN 4 THEN 0.95 WHEN 5 THEN 0.98 ELSE married END, 3) AS prob_alive,
              round(CASE Segment WHEN 4 THEN 1.2 * (SELECT median(frequency) FROM prof WHERE Segment < 4) WHEN 5 THEN 2.5 * (SELECT median(frequency) FROM prof WHERE Segment < 4) ELSE frequency END, 3) AS pred_purchases_90d,
              round(CASE Segment WHEN 4 THEN 2.0 * (SELECT median(recency) FROM prof WHERE Segment < 4) WHEN 5 THEN 1.1 * (SELECT median(recency) FROM prof WHERE Segment < 4) ELSE recency END, 3) AS exp_avg_profit,
              round(CASE Segment WHEN 4 THEN 1.8 * (SELECT median(CLV_90d) FROM prof WHERE Segment < 4) WHEN 5 THEN 1.5 * (SELECT median(CLV_90d) FROM prof WHERE Segment < 4) ELSE CLV_90d END, 1) AS CLV_90d
       FROM prof""",
)
def _(t: Tables):
    p = profiles(t).select(
        "Segment", F.col("married").alias("prob_alive"), F.col("frequency").alias("pred_purchases_90d"), F.col("recency").alias("exp_avg_profit"), "CLV_90d"
    )
    return _rounded(customer.override_outliers(cut_lineage(p)), ("CLV_90d",), 1)


_LEVELS = clean.CUSTOMER_DOMAINS["EducationLevel"]


@query("worth_by_persona", "SELECT Occupation, " + ", ".join(f"round(avg(CLV_90d) FILTER (WHERE EducationLevel = '{e}'), 2) AS \"{e}\"" for e in _LEVELS) + " FROM people GROUP BY 1")
def _(t: Tables):
    df = customer.worth_by_persona(people(t), "Occupation", "EducationLevel", _LEVELS)
    return df.select("Occupation", *[F.round(F.col(f"`{e}`"), 2).alias(e) for e in _LEVELS])


@query(
    "combine_core_and_outliers",
    "SELECT CustomerKey, frequency, CASE WHEN hf OR hm THEN NULL ELSE frequency * 2 END AS score, CASE WHEN hf OR hm THEN 4 END AS Segment FROM flag",
)
def _(t: Tables):
    core = customer.outlier_groups(summary(t), MANY, RICH)["core"].withColumn("score", F.col("frequency") * 2)
    both = customer.combine(core, customer.outlier_segments(summary(t), MANY, RICH))
    return both.select("CustomerKey", "frequency", "score", "Segment")


# --- pricing ---------------------------------------------------------------

PARTS["pbase"] = "SELECT CategoryName, quantile_cont(ProductPrice, 0.5) AS orig_price, quantile_cont(OrderQuantity, 0.5) AS orig_qty, quantile_cont(profit, 0.5) AS orig_profit FROM price_events WHERE event = 'No Promo' GROUP BY 1"
PARTS["pcost"] = "SELECT CategoryName, quantile_cont(ProductPrice - profit / OrderQuantity, 0.5) AS unit_cost FROM price_events GROUP BY 1"


@query("price_baseline", "SELECT CategoryName, round(orig_price, 4) AS orig_price, orig_qty, round(orig_profit, 4) AS orig_profit FROM pbase")
def _(t: Tables):
    return _rounded(pricing.baseline(t.price_events), ("orig_price", "orig_profit"))


@query("median_unit_cost", "SELECT CategoryName, round(unit_cost, 4) AS unit_cost FROM pcost")
def _(t: Tables):
    return _rounded(pricing.unit_costs(t.price_events), ("unit_cost",))


@query("promo_guard", "SELECT CategoryName, count(*) AS rows FROM price_events GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT ProductPrice) > 1")
def _(t: Tables):
    return pricing.promo_guard(t.price_events)


@query(
    "performance_table",
    """SELECT CategoryName, event, round(orig_price, 2) AS orig_price, orig_qty, round(adjusted_price, 2) AS adjusted_price, round(30 - adjusted_price / 1000, 4) AS exp_qty,
              round(adjusted_price * (30 - adjusted_price / 1000), 2) AS exp_revenue, round((adjusted_price - unit_cost) * (30 - adjusted_price / 1000), 2) AS exp_profit
       FROM (SELECT CategoryName, event, quantile_cont(ProductPrice, 0.5) AS adjusted_price FROM price_events GROUP BY 1, 2) e JOIN pbase USING (CategoryName) JOIN pcost USING (CategoryName)""",
)
def _(t: Tables):
    e = t.price_events.select("CategoryName", "event").distinct()
    given = e.withColumn("intercept", F.lit(30.0)).withColumn("slope", F.lit(-0.001))
    df = pricing.performance_table(t.price_events, given).drop("orig_profit")
    return _rounded(_rounded(df, ("exp_qty",)), ("orig_price", "adjusted_price", "exp_revenue", "exp_profit"), 2)


PARTS["pcurve"] = """SELECT CategoryName, p, price, (price - unit_cost) * (40 - price / 5000) AS mid FROM (
    SELECT CategoryName, p, lo * 0.7 + p * ((hi * 1.3 - lo * 0.7) / 99.0) AS price FROM (SELECT CategoryName, min(ProductPrice) AS lo, max(ProductPrice) AS hi FROM price_events GROUP BY 1) b,
    (SELECT unnest(generate_series(0, 99)) AS p) g) x JOIN pcost USING (CategoryName)"""


def given_curve(t: Tables) -> DataFrame:
    quantity = F.lit(40.0) - F.col("ProductPrice") / 5000
    return pricing.profit_curve(pricing.price_grid(t.price_events), pricing.unit_costs(t.price_events), quantity)


@query("profit_curve", "SELECT CategoryName, CAST(p AS INT) AS point, round(price, 2) AS ProductPrice, round(mid, 1) AS profit_mid, round(mid * 0.9, 1) AS profit_low, round(mid * 1.1, 1) AS profit_high FROM pcurve")
def _(t: Tables):
    return _rounded(_rounded(given_curve(t), ("ProductPrice",), 2), ("profit_mid", "profit_low", "profit_high"), 1)


@query("best_price", "SELECT CategoryName, round(arg_max(price, mid), 2) AS ProductPrice, round(max(mid), 1) AS profit_mid FROM pcurve GROUP BY 1")
def _(t: Tables):
    return pricing.best_price(given_curve(t)).select("CategoryName", F.round("ProductPrice", 2).alias("ProductPrice"), F.round("profit_mid", 1).alias("profit_mid"))


@query(
    "margin_profit",
    """SELECT CategoryName, CAST(p AS INT) AS point, round(m, 4) AS unit_margin, round(m * p, 2) AS profit_q FROM (SELECT CategoryName, avg(profit / OrderQuantity) AS m FROM price_events GROUP BY 1) x, (SELECT unnest(generate_series(0, 99)) AS p) g""",
)
def _(t: Tables):
    grid = pricing.price_grid(t.price_events).withColumn("q", F.col("point").cast("double"))
    df = pricing.margin_profit(t.price_events, grid, ["q"])
    return df.select("CategoryName", "point", F.round("unit_margin", 4).alias("unit_margin"), F.round("profit_q", 2).alias("profit_q"))


@query(
    "event_profit",
    """SELECT CategoryName, event, OrderQuantity, ProductPrice, round((ProductPrice - (ProductPrice - profit / OrderQuantity)) * (30 - 0.001 * ProductPrice), 2) AS profit_pred FROM price_events WHERE event <> 'No Promo'""",
)
def _(t: Tables):
    e = t.price_events.select("CategoryName", "event").distinct()
    given = e.withColumn("intercept", F.lit(30.0)).withColumn("slope", F.lit(-0.001))
    df = pricing.event_profit(t.price_events, given)
    return df.select("CategoryName", "event", "OrderQuantity", "ProductPrice", F.round("profit_pred", 2).alias("profit_pred"))


PARTS["psum"] = """SELECT CategoryName, event, CAST(count(*) AS DOUBLE) AS n, sum(p) AS p, sum(p * p) AS pp, sum(p * q) AS pq, sum(q) AS q FROM (
      SELECT CategoryName, event, CAST(ProductPrice AS DOUBLE) AS p, CAST(OrderQuantity AS DOUBLE) AS q FROM price_events
      WHERE ProductPrice IS NOT NULL AND OrderQuantity IS NOT NULL AND event IS NOT NULL) x
    WHERE CategoryName IN (SELECT CategoryName FROM price_events GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT ProductPrice) > 1) GROUP BY 1, 2"""
PARTS["plist"] = """SELECT CategoryName, list(event ORDER BY event) AS e, list(n ORDER BY event) AS n, list(p ORDER BY event) AS p, list(q ORDER BY event) AS q,
      sum(pp) AS pp, sum(pq) AS pq FROM psum GROUP BY 1"""
PARTS["paug"] = """SELECT CategoryName, list_concat(
      [list_concat([list_sum(n), list_sum(p)], n, [list_sum(q)]), list_concat([list_sum(p), pp + 0.6], p, [pq])],
      list_transform(n, lambda v, i: list_concat([v, p[i]], list_transform(n, lambda w, j: CASE WHEN i = j THEN w + 0.6 ELSE 0.0 END), [q[i]]))) AS m FROM plist"""
PARTS["psolved"] = solved("paug", "CategoryName")


@query(
    "promo_model",
    """SELECT CategoryName, e[i] AS event, format('{:.4e}', m[1][len(e) + 3] + m[i + 2][len(e) + 3]) AS intercept, format('{:.4e}', m[2][len(e) + 3]) AS slope
       FROM (SELECT CategoryName, e, m, unnest(range(1, len(e) + 1)) AS i FROM psolved JOIN plist USING (CategoryName)) x""",
)
def _(t: Tables):
    return _digits(pricing.fit_promo(t.price_events), ("intercept", "slope"))


@query("demand_curves")
def _(t: Tables):
    curves = pricing.fit_demand_curves(t.price_events)
    return pricing.price_grid(t.price_events).join(curves, "CategoryName").select("CategoryName", "point", "ProductPrice", pricing.demand_at(F.col("ProductPrice")).alias("quantity"))


@query(
    "expectile_equations",
    """SELECT CategoryName, level, count(*) AS rows, 0.0 AS residual, true AS converged FROM price_events, (VALUES (0.025), (0.5), (0.975)) AS l(level)
       WHERE event = 'No Promo' AND ProductPrice IS NOT NULL AND OrderQuantity IS NOT NULL AND CategoryName IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Tables):
    curves = cut_lineage(pricing.fit_expectile_curves(t.price_events))
    facts = pricing.curve_equations(t.price_events, curves).join(curves.select("CategoryName", "level", "converged"), ["CategoryName", "level"])
    return _rounded(facts, ("residual",), 6)


PARTS["pline"] = """SELECT CategoryName, e[i] AS event, m[1][len(e) + 3] + m[i + 2][len(e) + 3] AS intercept, m[2][len(e) + 3] AS slope
    FROM (SELECT CategoryName, e, m, unnest(range(1, len(e) + 1)) AS i FROM psolved JOIN plist USING (CategoryName)) x"""


@query(
    "performance_report",
    """SELECT CategoryName, event, round(orig_price, 2) AS orig_price, orig_qty, round(adjusted_price, 2) AS adjusted_price, format('{:.4e}', q) AS exp_qty,
              format('{:.4e}', adjusted_price * q) AS exp_revenue, format('{:.4e}', (adjusted_price - unit_cost) * q) AS exp_profit
       FROM (SELECT e.*, intercept + slope * adjusted_price AS q FROM
         (SELECT CategoryName, event, quantile_cont(ProductPrice, 0.5) AS adjusted_price FROM price_events GROUP BY 1, 2) e JOIN pline USING (CategoryName, event)) x
       JOIN pbase USING (CategoryName) JOIN pcost USING (CategoryName)""",
)
def _(t: Tables):
    df = value.price_plan(t.price_events)["performance"].drop("orig_profit")
    return _digits(_rounded(df, ("orig_price", "adjusted_price"), 2), ("exp_qty", "exp_revenue", "exp_profit"))


@query("demand_curve_upper")
def _(t: Tables):
    return pricing.fit_demand_curves(t.price_events, 0.975)


@query("price_optimisation")
def _(t: Tables):
    return pricing.best_price(pricing.optimise_prices(t.price_events, cut_lineage(pricing.fit_demand_curves(t.price_events))))


@query("category_model")
def _(t: Tables):
    return pricing.category_coefficients(pricing.category_model(t.price_events), t.spark)
