"""Properties and brute-force checks of operators without a SQL oracle."""

import datetime as dt
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions import dates
from tillwise.functions.numeric import digamma, lgamma, trigamma
from tillwise.operators import (
    basket, clean, customer, encoding, evaluate, forecast, impute, inventory, lifetime, marketing, ordering, panel as panels, pricing, profile, regress, routing,
)
from tillwise.plans import demand, value

ITEM = "SubcategoryName"


@pytest.fixture(scope="module")
def tiny_panel(spark):
    """Three items over 120 days: dense weekly, moderate, and silent."""
    rows = []
    start = dt.date(2017, 1, 1)
    for i in range(120):
        d = start + dt.timedelta(days=i)
        rows.append((d, "Dense", 20 + 5 * (d.weekday() == 5) + i % 3, start))
        rows.append((d, "Some", 4 if i % 2 else 0, start))
        rows.append((d, "Silent", 0, start))
    return spark.createDataFrame(rows, "OrderDate date, SubcategoryName string, OrderQuantity int, StockDate date").cache()


def test_quantiles_with_a_hot_key_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 4000), 2)]
    data += [("neg", float(v)) for v in rng.normal(0, 5, 301)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = {r.k: list(r)[1:] for r in ordering.quantiles(df, "v", probs, ["k"]).collect()}
    for key in ("hot", "neg", "one"):
        values = [v for k, v in data if k == key]
        assert got[key] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert "none" not in got
    everything = list(ordering.quantiles(df, "v", probs).first())
    assert everything == pytest.approx(list(np.quantile([v for _, v in data if v is not None], probs)), rel=1e-12)


def test_global_index_and_shuffle(spark):
    df = spark.createDataFrame([(i % 3, i, i * 2) for i in range(100)], "b int, k int, v int")
    numbered = ordering.global_index(df, "b", ["k"]).orderBy("row_index").collect()
    assert [r.row_index for r in numbered] == list(range(100))
    assert [(r.b, r.k) for r in numbered] == sorted((i % 3, i) for i in range(100))
    mixed = ordering.shuffled_partner(df, ["k"], "v", 5, 8).collect()
    assert Counter(r.v for r in mixed) == Counter(i * 2 for i in range(100))
    assert sum(r.v == r.k * 2 for r in mixed) < 20


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert spark.range(1).select(ordering.mode_value(df, "c")).first()[0] == "a"


def test_lgamma(spark):
    zs = [1e-3, 0.2, 1.0, 2.5, 10.0, 321.7]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(lgamma(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(z) for z in zs], rel=1e-10, abs=1e-10)


def test_federal_holidays(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2016-01-01', DATE '2017-12-31')) AS d")
    got = {r.d.isoformat() for r in days.filter(dates.is_us_federal_holiday(F.col("d"))).collect()}
    assert {"2016-01-01", "2016-12-26", "2017-01-02", "2017-01-16", "2017-02-20", "2017-05-29", "2017-07-04", "2017-09-04",
            "2017-10-09", "2017-11-10", "2017-11-23", "2017-12-25"} <= got
    assert len(got) == 20


def test_encoding_is_persistent(spark):
    known = spark.createDataFrame([("Pumps", 0), ("Bike Racks", 7)], "SubcategoryName string, id int")
    new = spark.createDataFrame([("Vests",), ("Pumps",), ("Caps",), (None,)], "SubcategoryName string")
    got = {r.SubcategoryName: r.id for r in encoding.extend_encoding(known, new).collect()}
    assert got == {"Pumps": 0, "Bike Racks": 7, "Caps": 8, "Unknown": 9, "Vests": 10}
    fresh = {r.SubcategoryName: r.id for r in encoding.extend_encoding(None, new).collect()}
    assert fresh == {"Caps": 0, "Pumps": 1, "Unknown": 2, "Vests": 3}
    coded = encoding.encode_items(new, encoding.extend_encoding(None, new)).collect()
    assert sorted(r.SubcategoryName for r in coded) == [0, 1, 2, 3]


def test_quantiles_leave_out_nan(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("nan"), None)], "v double")
    assert ordering.quantiles(df, "v", [0.5]).first()[0] == 2.0
    keyed = ordering.medians(df.withColumn("k", F.lit("a")), {"m": "v"}, ["k"]).first()
    assert keyed.m == 2.0


def test_quantiles_of_values_in_one_bucket_and_a_hot_key(spark):
    rng = np.random.default_rng(9)
    close = 1.7e9 + rng.integers(0, 5000, 4000)
    rows = [("hot", float(v)) for v in close] + [("cold", float(v)) for v in rng.random(10) * 1e-5]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: (r.a, r.b) for r in ordering.quantiles(df, "v", [0.25, 0.9], ["k"], ["a", "b"]).collect()}
    for k in ("hot", "cold"):
        values = [v for name, v in rows if name == k]
        assert got[k] == pytest.approx(tuple(np.quantile(values, [0.25, 0.9])), rel=1e-12)


def test_routes(tiny_panel):
    got = {r[ITEM]: r.TargetModel for r in routing.route(routing.metrics(tiny_panel), routing.SALES_POLICY).collect()}
    assert got == {"Dense": "AutoARIMA", "Some": "Prophet", "Silent": "ColdStart"}


def test_forecasts_cover_every_item_and_day(tiny_panel):
    daily = demand.sales_forecast(tiny_panel).collect()
    assert Counter(r[ITEM] for r in daily) == {"Dense": 30, "Some": 30, "Silent": 30}
    assert min(r.qty for r in daily) >= 0
    dense = [r.qty for r in daily if r[ITEM] == "Dense"]
    assert 18 < sum(dense) / 30 < 26
    assert {r.date for r in daily} == {dt.date(2017, 5, 1) + dt.timedelta(days=i) for i in range(30)}


def test_autoregression_recovers_a_known_recursion(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    for _ in range(120):
        y.append(2 + 0.3 * y[-1] + 0.5 * y[-7])
    start = dt.date(2017, 1, 1)
    df = spark.createDataFrame(
        [(start + dt.timedelta(days=i), "A", v) for i, v in enumerate(y)], "OrderDate date, SubcategoryName string, OrderQuantity double"
    )
    ahead = forecast.autoregression_forecast(forecast.fit_autoregression(df), df, 5).orderBy("date").collect()
    expected = list(y)
    for _ in range(5):
        expected.append(2 + 0.3 * expected[-1] + 0.5 * expected[-7])
    assert [r.yhat for r in ahead] == pytest.approx(expected[-5:], rel=1e-5)


def test_stocking_rules(spark):
    rows = [("21", "AutoARIMA", dt.date(2017, 7, 1 + i), 10.167) for i in range(30)]
    rows += [("4", "ColdStart", dt.date(2017, 7, 1 + i), float(5 * (i % 10 == 0))) for i in range(30)]
    daily = spark.createDataFrame(rows, "SubcategoryName string, model_source string, date date, qty double")
    got = {r.item_id: r for r in inventory.stocking_report(daily).collect()}
    assert (got["21"].forecasted_sales_total, got["21"].safety_stock_estimate, got["21"].total_stock_recommendation) == (305.01, 45.75, 350.76)
    assert got["4"].safety_stock_estimate == 4.5 and got["4"].stock_logic == "Volatility-Adjusted"


def test_published_budget_split(spark):
    budgets = spark.createDataFrame([(15000.0,), (20000.0,)], "budget double")
    got = {(r.budget, r.channel): (r.allocation, round(r.expected_profit, 2)) for r in marketing.budget_strategies(budgets).collect()}
    assert got[(15000.0, "facebook_s")] == (pytest.approx(8250.0), 14602.5)
    assert got[(15000.0, "tv_s")] == (pytest.approx(4500.0), 4050.0)
    assert got[(20000.0, "facebook_s")] == (pytest.approx(10000.0), 17700.0)
    assert got[(20000.0, "tv_s")] == (pytest.approx(7000.0), 6300.0)
    assert got[(20000.0, "search_s")] == (pytest.approx(1000.0), 40.0)


def test_allocation_is_feasible_and_best(spark):
    rows = [(s, f"c{i}", 1000.0, w) for s, ws in enumerate(([3, 2, 1, 5, 4], [1, 1, 1, 1, 1])) for i, w in enumerate(map(float, ws))]
    df = spark.createDataFrame(rows, "s int, channel string, budget double, weight double")
    out = marketing.best_allocation(df, ["s"]).collect()
    for s in (0, 1):
        part = [r.allocation for r in out if r.s == s]
        assert sum(part) == pytest.approx(1000.0) and min(part) >= 50 - 1e-9 and max(part) <= 500 + 1e-9
    assert all(r.feasible for r in out)
    few = marketing.best_allocation(df.filter("channel = 'c0'"), ["s"]).collect()
    many = df.filter("s = 0").withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("channel", F.col("channel").cast("string"))
    for r in [*few, *marketing.best_allocation(many, ["s"]).collect()]:
        assert not r.feasible and r.allocation is None and r.contribution is None
    best = {r.channel: r.allocation for r in out if r.s == 0}
    assert best["c3"] == pytest.approx(500.0) and best["c4"] == pytest.approx(350.0)


def test_adstock_matches_the_recursion(spark):
    s = [10.0, 0.0, 5.0, 0.0, 0.0, 8.0]
    rows = [(dt.date(2017, 1, 2) + dt.timedelta(days=7 * i), "tv_s", v) for i, v in enumerate(s)]
    out = marketing.adstock(spark.createDataFrame(rows, "date date, channel string, spend double"), {"tv_s": 0.7}).orderBy("date")
    x, expected = 0.0, []
    for v in s:
        x = v + 0.7 * x
        expected.append(x)
    assert [r.adstock for r in out.collect()] == pytest.approx(expected)


def test_adstock_of_any_rate_over_many_blocks(spark):
    rates = {"a": 1.0, "b": 0.2, "c": 0.0, "d": 1.001, "e": 0.999}
    start, weeks = dt.date(1980, 1, 7), 700
    rows = [(start + dt.timedelta(days=7 * i), c, float((i * 7 + k) % 5), "m") for i in range(weeks) for k, c in enumerate(rates)]
    df = spark.createDataFrame(rows, "date date, channel string, spend double, market string").repartition(5)
    out = marketing.adstock(df, rates)
    assert out.columns == [*df.columns, "adstock"]
    got = {(r.channel, r.date): r.adstock for r in out.collect()}
    for k, (c, rate) in enumerate(rates.items()):
        x = 0.0
        for i in range(weeks):
            x = x * rate + (i * 7 + k) % 5
            assert got[c, start + dt.timedelta(days=7 * i)] == pytest.approx(x)


def test_expected_purchases_take_enough_terms(spark):
    """Young customers, where the series needs many terms, against the plain sum."""
    model = customer.FrequencyModel(r=0.3, alpha=2.0, a=4.0, b=8.0)
    df = spark.createDataFrame([(1, 2.0, 3.0), (0, 0.0, 0.5), (4, 300.0, 400.0)], "frequency int, recency double, T double")
    got = [r[0] for r in df.select(customer.expected_purchases(model, 90)).collect()]
    for value, (x, tx, t) in zip(got, df.collect()):
        z = 90 / (2.0 + t + 90)
        total, term, n = 0.0, 1.0, 0
        while n < 60_000:
            total += term
            term *= (0.3 + x + n) * (8.0 + x + n) / ((11.0 + x + n) * (n + 1)) * z
            n += 1
        survive = 1 - ((2.0 + t) / (2.0 + t + 90)) ** (0.3 + x) * total
        odds = (4.0 / (7.0 + x) * ((2.0 + t) / (2.0 + tx)) ** (0.3 + x)) if x else 0.0
        assert value == pytest.approx((11.0 + x) / 3.0 * survive / (1 + odds), rel=1e-8)


def test_roi_is_ordered_exactly_and_rounded_half_even(spark):
    carried = spark.createDataFrame([("a", 1000.0, 1002.0), ("b", 1000.0, 1004.0), ("c", 8.0, 1.0)], "channel string, spend double, adstock double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "channel string, weight double")
    rows = marketing.roi_table(carried, weights).collect()
    assert [r.channel for r in rows] == ["b", "a", "c"] and [r.roi for r in rows] == [1.0, 1.0, 0.12]


def plain_rules(supports, min_lift, min_confidence):
    out = {}
    for items, s in supports.items():
        for mask in range(1, 2 ** len(items) - 1):
            left = tuple(x for i, x in enumerate(items) if mask >> i & 1)
            right = tuple(x for x in items if x not in left)
            confidence = s / supports[left]
            if confidence >= min_confidence and confidence / supports[right] >= min_lift:
                out[left, right] = (round(confidence, 9), round(confidence / supports[right], 9))
    return out


@pytest.mark.parametrize("min_lift,min_confidence", [(0.0, 0.0), (1.05, 0.6), (0.0, 0.95)])
def test_rules_match_all_splits(spark, min_lift, min_confidence):
    rng = np.random.default_rng(8)
    orders = [frozenset(x for x in "abcdefg" if rng.random() < 0.55) | (frozenset("xy") if rng.random() < 0.3 else frozenset()) for _ in range(300)]
    names = sorted({x for o in orders for x in o})
    supports = {}
    for n in range(1, len(names) + 1):
        for items in itertools.combinations(names, n):
            share = sum(o.issuperset(items) for o in orders) / len(orders)
            if share >= 0.08:
                supports[items] = share
    sets = spark.createDataFrame([(list(reversed(k)), v) for k, v in supports.items()], "items array<string>, support double")
    got = {(tuple(r.antecedents), tuple(r.consequents)): (round(r.confidence, 9), round(r.lift, 9)) for r in basket.rules(sets, min_lift, min_confidence).collect()}
    assert got == plain_rules(supports, min_lift, min_confidence)
    assert len(got) > 20 and max(map(len, supports)) >= 4


def test_rules_of_a_set_of_25_items(spark):
    """All but two items make the two others likely; consequents that are weak are never grown."""
    items = [f"i{k:02d}" for k in range(25)]
    rest = lambda *gone: [x for x in items if x not in gone]
    rows = [(items, 0.3), (rest("i00", "i01"), 0.35)]
    rows += [(rest(x), 0.31 if x in ("i00", "i01") else 0.9) for x in items] + [([x], 0.95) for x in items] + [(["i00", "i01"], 0.5)]
    sets = spark.createDataFrame(rows, "items array<string>, support double")
    got = basket.rules(sets, 0.0, 0.8).filter(F.size("antecedents") + F.size("consequents") == 25).collect()
    assert {tuple(r.consequents): round(r.confidence, 4) for r in got} == {("i00",): 0.9677, ("i01",): 0.9677, ("i00", "i01"): 0.8571}


def test_channel_plan_weights(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        spend = rng.uniform(10, 100, 5)
        rows.append((dt.date(2016, 1, 4) + dt.timedelta(days=7 * i), *map(float, spend)))
    df = spark.createDataFrame(rows, "date date, tv_s double, ooh_s double, print_s double, facebook_s double, search_s double")
    carried = marketing.feature_table(df.withColumn("profit", F.lit(0.0)))
    true = {"tv_s": 0.9, "ooh_s": 0.5, "print_s": 0.2, "facebook_s": 1.7, "search_s": 0.1}
    total = F.lit(40.0)
    for c, w in true.items():
        total = total + F.col(c) * w
    profit = carried.select("date", total.alias("profit"))
    plan = value.channel_plan(df.join(profit, "date"))
    got = {r.feature: r.coefficient for r in plan["weights"].collect()}
    for c, w in true.items():
        assert got[c] == pytest.approx(w, abs=1e-5)
    assert abs(got["trend"]) < 1e-5
    top = plan["waterfall"].orderBy(F.desc("position")).first().top
    assert top == pytest.approx(profit.agg(F.sum("profit")).first()[0], rel=1e-6)


def test_least_squares_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [("g" if i % 3 else "h", 1.0, float(a), float(b), float(2 * a - b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "k string, one double, a double, b double, y double")
    fit = regress.least_squares(df, ["k"], ["one", "a", "b"], "y")
    res = df.join(fit, "k").withColumn("e", F.col("y") - regress.dot(F.col("coefficients"), [F.col("one"), F.col("a"), F.col("b")]))
    for r in res.groupBy("k").agg(F.sum("e"), F.sum(F.col("e") * F.col("a")), F.sum(F.col("e") * F.col("b"))).collect():
        assert max(abs(v) for v in r[1:]) < 1e-8


def test_rules_enumerate_all_splits_with_a_hot_order(spark):
    orders = [(f"o{i}", x) for i in range(40) for x in ("A", "B", "C")] + [(f"p{i}", "A") for i in range(30)] + [(f"q{i}", "D") for i in range(30)]
    hot = [("o0", x) for x in ("A", "B", "C")] * 500
    lines = spark.createDataFrame(orders + hot, "OrderNumber string, SubcategoryName string")
    sets = basket.frequent_itemsets(basket.baskets(lines, min_support=0.1), 0.1).cache()
    got = {tuple(r["items"]): r.support for r in sets.collect()}
    assert got[("A", "B", "C")] == 0.4 and got[("A",)] == 0.7 and len(got) == 8
    rules = basket.rules(sets).collect()
    assert len(rules) == 12
    abc = [r for r in rules if list(r.antecedents) == ["B", "C"]][0]
    assert (abc.confidence, abc.lift) == (1.0, pytest.approx(1 / 0.7))
    strong = basket.significant_rules(basket.rules(sets)).collect()
    assert len(strong) == 4


def _all_sets(baskets, least):
    from itertools import combinations

    counts = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for s in combinations(sorted(b), k):
                counts[s] = counts.get(s, 0) + 1
    return {s: c for s, c in counts.items() if c >= least}


@pytest.mark.parametrize("rows_per_item", [0, 1, 32])
def test_itemsets_of_every_size_whichever_way_they_are_counted(spark, monkeypatch, rows_per_item):
    monkeypatch.setattr(basket, "_ROWS_PER_ITEM", rows_per_item)
    rng = np.random.default_rng(5)
    made = [[x for x in "ABCDEFG" if rng.random() < 0.55] for _ in range(120)] + [[], []]
    df = spark.createDataFrame([(b,) for b in made] + [(None,)], "items array<string>")
    got = basket.frequent_itemsets(df, 0.1).collect()
    assert {tuple(r["items"]): r.freq for r in got} == _all_sets(made, 13) and len(got) == len({tuple(r["items"]) for r in got})
    assert max(len(r["items"]) for r in got) > 3 and all(r.support == r.freq / 123 for r in got)


def test_small_itemsets_are_not_mined(spark, monkeypatch):
    """Pairs of many short baskets are counted in one pass; no tree of every basket is built."""
    monkeypatch.setattr(basket, "FPGrowth", None)
    df = spark.createDataFrame([([a, b],) for a in "ABC" for b in "DEF"] * 5, "items array<string>")
    got = {tuple(r["items"]): r.freq for r in basket.frequent_itemsets(df, 0.1).collect()}
    assert len(got) == 15 and got[("A", "D")] == 5 and got[("F",)] == 15


def test_baskets_read_the_lines_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    lines = spark.createDataFrame([("o1", "A"), ("o1", "B"), ("o2", "A"), ("o3", None)], "OrderNumber string, SubcategoryName string").coalesce(1)
    got = basket.baskets(lines.mapInPandas(counted, lines.schema), min_support=0.6).collect()
    assert {(r.OrderNumber, tuple(r["items"])) for r in got} == {("o1", ("A",)), ("o2", ("A",))}
    assert reads.value == 1


def _counting(df, reads):
    """``df`` computed by a task that adds one to ``reads`` each time."""

    def counted(batches):
        reads.add(1)
        yield from batches

    return df.coalesce(1).mapInPandas(counted, df.schema)


def test_panels_compute_the_daily_totals_once(spark):
    reads = spark.sparkContext.accumulator(0)
    items = spark.createDataFrame([("A",), ("B",)], "SubcategoryName string")
    sold = spark.sql("SELECT DATE'2020-01-01' AS OrderDate, 'A' AS SubcategoryName, 3L AS OrderQuantity, DATE'2019-12-01' AS StockDate UNION ALL SELECT DATE'2020-01-03', 'B', 2L, NULL")
    got = panels.sales_panel(_counting(sold, reads), items).collect()
    assert len(got) == 6 and sum(r.OrderQuantity for r in got) == 5 and reads.value == 1
    reads = spark.sparkContext.accumulator(0)
    gathered = spark.sql("SELECT DATE'2020-01-01' AS ReturnDate, 3 AS ReturnQuantity, 'A' AS SubcategoryName, DATE'2020-01-01' AS OrderDate, 4 AS OrderQuantity UNION ALL SELECT DATE'2020-01-04', 1, 'B', DATE'2020-01-04', 5")
    got = panels.returns_panel(_counting(gathered, reads), items).collect()
    assert len(got) == 8 and sum(r.ReturnQuantity for r in got) == 4 and reads.value == 1


def test_metric_summary_computes_the_metrics_once(spark):
    reads = spark.sparkContext.accumulator(0)
    metrics = spark.createDataFrame([(f"i{k}", float(k), 10.0 * k) for k in range(5)] + [("n", None, 1.0)], "SubcategoryName string, rmse double, smape double")
    got = {r.metric: tuple(r)[1:] for r in evaluate.metric_summary(_counting(metrics, reads), ["rmse", "smape"]).collect()}
    assert got == {"rmse": (2.0, 2.0, 0.0, 4.0), "smape": (pytest.approx(101 / 6), 15.0, 0.0, 40.0)} and reads.value == 1


def test_purchase_models_improve_and_score(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        T = int(rng.integers(100, 700))
        lam, p = rng.gamma(2, 1 / 80), rng.beta(1.0, 3.0)
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > T:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        rows.append((i, x, int(last), T, float(rng.gamma(6, 10)) if x else 0.0))
    df = spark.createDataFrame(rows, "CustomerKey int, frequency int, recency int, T int, monetary_value double").cache()
    model = customer.fit_frequency_model(df, penalty=0.0)
    assert 0.7 < model.r < 6 and 0.1 < model.a / (model.a + model.b) < 0.6
    spend = customer.fit_spend_model(df)
    scored = customer.score(df.filter("frequency > 0"), model, spend).agg(
        F.min("prob_alive"), F.max("prob_alive"), F.min("pred_purchases_90d"), F.count_if(F.col("CLV_90d").isNull())
    ).first()
    assert scored[0] >= 0 and scored[1] <= 1 and scored[2] > 0 and scored[3] == 0


def test_polygammas(spark):
    zs = [1e-2, 0.3, 1.0, 2.5, 40.0, 900.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(digamma(F.col("z")), trigamma(F.col("z"))).collect()
    for z, (first, second) in zip(zs, rows):
        h = 1e-4 * z
        assert first == pytest.approx((math.lgamma(z + h) - math.lgamma(z - h)) / (2 * h), rel=1e-5, abs=1e-6)
        exact = sum(1 / (z + k) ** 2 for k in range(4000)) + 1 / (z + 3999.5)
        assert second == pytest.approx(exact, rel=1e-6)


def plain_frequency_loss(rows, point, penalty):
    r, alpha, a, b = point
    g, total = math.lgamma, 0.0
    for x, tx, t in rows:
        alive, gone = -(r + x) * math.log(alpha + t), math.log(a) - math.log(b + max(x, 1) - 1) - (r + x) * math.log(alpha + tx)
        tail = np.logaddexp(alive, gone) if x else alive
        total += g(r + x) - g(r) + r * math.log(alpha) + g(a + b) + g(b + x) - g(b) - g(a + b + x) + tail
    return -total / len(rows) + penalty * sum(v * v for v in point)


def plain_spend_loss(rows, point, penalty):
    p, q, v = point
    g = math.lgamma
    total = sum(g(p * x + q) - g(p * x) - g(q) + q * math.log(v) + (p * x - 1) * math.log(m) + p * x * math.log(x) - (p * x + q) * math.log(x * m + v) for x, m in rows)
    return -total / len(rows) + penalty * sum(w * w for w in point)


def test_likelihood_derivatives_and_optimum(spark):
    """Gradient and Hessian columns against differences of a plain loss; the fit ends where the slope is zero."""
    rng = np.random.default_rng(6)
    rows = [(int(x), float(tx), float(tx + e)) for x, tx, e in zip(rng.poisson(1.5, 80), rng.uniform(0.5, 5, 80), rng.uniform(0.1, 5, 80))]
    rows = [(x, tx if x else 0.0, t) for x, tx, t in rows] + [(3, 2.0, 2.0)]
    spends = [(int(x), float(m)) for x, m in zip(rng.integers(1, 6, 60), rng.gamma(3, 4, 60))]
    one = spark.createDataFrame([(float(x), tx, t, 1.0) for x, tx, t in rows], "x double, tx double, t double, weight double").cache()
    two = spark.createDataFrame([(float(x), m, 1.0) for x, m in spends], "x double, m double, weight double").cache()
    for table, terms, loss, data, point in (
        (one, lifetime.frequency_terms, plain_frequency_loss, rows, [0.8, 3.0, 0.7, 2.2]),
        (two, lifetime.spend_terms, plain_spend_loss, spends, [1.4, 2.3, 5.0]),
    ):
        at, x = lifetime.penalised(table, terms, 0.05), np.log(point)
        value, gradient, hessian = at(x)
        assert value == pytest.approx(loss(data, point, 0.05), rel=1e-10)
        h = 1e-4
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += h
            down[i] -= h
            assert gradient[i] == pytest.approx((loss(data, np.exp(up), 0.05) - loss(data, np.exp(down), 0.05)) / (2 * h), rel=1e-5, abs=1e-6)
            assert hessian[i] == pytest.approx((at(up)[1] - at(down)[1]) / (2 * h), rel=1e-4, abs=1e-5)
        found, rounds, slope, converged = lifetime.newton(at, [0.0] * len(x), 50)
        assert converged and slope < 1e-6 and rounds < 30
        best = loss(data, np.exp(found), 0.05)
        for _ in range(30):
            assert loss(data, np.exp(found + 0.05 * rng.normal(size=len(x))), 0.05) > best
    _, rounds, slope, converged = lifetime.newton(at, [0.0] * 3, 1)
    assert not converged and rounds == 1
    assert lifetime.newton(lifetime.penalised(two.limit(0), lifetime.spend_terms, 0.1), [0.0] * 3, 5)[3] is False


def test_imputation_keeps_observed_cells(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        a, b = rng.normal(size=2)
        rows.append((i, float(a), float(b), None if i % 5 == 0 else float(3 * a - 2 * b + 1)))
    df = spark.createDataFrame(rows, "CustomerKey int, a double, b double, c double")
    out = {r.CustomerKey: r for r in customer.impute_chained(df, ["a", "b", "c"]).collect()}
    for k, a, b, c in rows:
        assert (out[k].a, out[k].b) == (a, b)
        assert out[k].c == pytest.approx(3 * a - 2 * b + 1 if c is None else c, abs=1e-3)


def plain_chained(rows, rounds, tol, ridge=1e-6):
    """Row by row: fill with means, then regress each incomplete column on all others, in turn."""
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    gap = np.isnan(x)
    top = np.nanmax(np.abs(x))
    x = np.where(gap, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        before = x.copy()
        for c in sorted((c for c in range(x.shape[1]) if gap[:, c].any()), key=lambda c: gap[:, c].sum()):
            design = np.column_stack([np.ones(len(x)), np.delete(x, c, axis=1)])
            seen = design[~gap[:, c]]
            gram = seen.T @ seen
            scale = np.sqrt(np.diag(gram))
            beta = np.linalg.solve(gram / np.outer(scale, scale) + ridge * np.eye(len(gram)), seen.T @ x[~gap[:, c], c] / scale) / scale
            x[gap[:, c], c] = design[gap[:, c]] @ beta
        if np.abs(x - before).max() < tol * top:
            break
    return x


@pytest.mark.parametrize("tol", [1e-3, 1e-9])
def test_imputation_matches_row_by_row_rounds(spark, tol):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 4)) + 0.3 * rng.normal(size=(400, 4)) + [5, 0, -3, 100]
    lost = rng.random((400, 4)) < [0.0, 0.3, 0.1, 0.2]
    rows = [[None if gone else float(v) for v, gone in zip(r, g)] for r, g in zip(base, lost)]
    df = spark.createDataFrame([(i, *r, "x", i) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double, _pattern string, _fill int").repartition(5)
    model = impute.fit_imputation(df, ["a", "b", "c", "d"], rounds=12, tol=tol)
    assert model.targets == ["c", "d", "b"] and len(model.fills) == 7
    filled = model.apply(df)
    assert filled.columns == df.columns
    got = {r.id: [r.a, r.b, r.c, r.d] for r in filled.collect()}
    expected = plain_chained(rows, 12, tol)
    assert np.allclose([got[i] for i in range(400)], expected, rtol=1e-7, atol=1e-7)
    facts = {r.target: r for r in impute.equation_check(df, filled, model, ["id"]).collect()}
    assert {t: r.filled for t, r in facts.items()} == {c: int(lost[:, "abcd".index(c)].sum()) for c in "bcd"}
    assert all(r.changed == 0 and r.misfit < max(tol, 1e-6) * 2 and r.residual < 1e-2 for r in facts.values())


def test_open_rounds_are_settled_together(spark, monkeypatch):
    """Rounds that the moments leave open take few scans, and stop where a scan each would."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=(2000, 1)) @ rng.normal(size=(1, 3)) + 0.25 * rng.normal(size=(2000, 3))
    lost = rng.random((2000, 3)) < [0.6, 0.6, 0.0]
    rows = [[None if gone else float(v) for v, gone in zip(r, g)] for r, g in zip(base, lost)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    scans, scan = [], impute._largest_changes
    monkeypatch.setattr(impute, "_largest_changes", lambda rows, deltas, k: scans.append(len(deltas)) or scan(rows, deltas, k))
    models = []
    for cells in (1, 1 << 20):
        monkeypatch.setattr(impute, "_CELLS", cells)
        models.append(impute.fit_imputation(df, ["a", "b", "c"], rounds=200, tol=1e-6))
        scans.append(None)
    one, many = models
    assert one.converged and many.converged and one.rounds == many.rounds and one.change == pytest.approx(many.change)
    assert all(np.array_equal(one.fills[p], many.fills[p]) for p in one.fills) and one.equations.keys() == many.equations.keys()
    alone = scans.index(None)
    assert alone >= 4 and len(scans) - 2 - alone <= 2


def test_purchase_summary_reads_the_history_once(spark):
    reads = spark.sparkContext.accumulator(0)
    history = spark.sql("SELECT DATE'2020-01-01' AS OrderDate, 1 AS CustomerKey, 2.0D AS Profit UNION ALL SELECT DATE'2020-01-05', 1, 4.0D UNION ALL SELECT DATE'2020-01-09', 2, 1.0D")
    got = {tuple(r) for r in customer.purchase_summary(_counting(history, reads)).collect()}
    assert got == {(1, 1, 4, 8, 4.0), (2, 0, 0, 0, 0.0)} and reads.value == 1


def test_imputation_of_odd_tables(spark):
    schema = "id int, a double, b double, c double"
    df = spark.createDataFrame([(1, 1.0, None, None), (2, 2.0, 5.0, None), (3, float("nan"), 7.0, None), (4, None, None, None)], schema)
    rows = impute.fit_imputation(df, ["a", "b", "c"]).apply(df).collect()
    assert all(None not in r and r.c == 0 and not any(math.isnan(v) for v in r[1:]) for r in rows)
    whole = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], schema)
    model = impute.fit_imputation(whole, ["a", "b", "c"])
    assert model.targets == [] and model.converged and model.apply(whole).collect() == whole.collect()
    assert impute.equation_check(whole, whole, model, ["id"]).collect() == []
    assert impute.fit_imputation(whole.limit(0), ["a", "b", "c"]).apply(whole.limit(0)).collect() == []


def test_segments_carry_meaning(spark):
    groups = {0: (1, 900, 50), 1: (5, 700, 900), 2: (2, 100, 800), 3: (5, 700, 60)}
    rows = [(s * 100 + j, s, f + j % 2, r + j, float(m + j)) for s, (f, r, m) in groups.items() for j in range(30)]
    df = spark.createDataFrame(rows, "CustomerKey int, truth int, frequency int, recency int, monetary_value double")
    got = customer.assign_segments(df, customer.fit_segments(df, restarts=3)).collect()
    assert all(r.Segment == r.truth for r in got)


def test_demand_curve_and_promo_model(spark):
    rows = []
    for i in range(300):
        price = 10 + (i % 60) * 0.5
        event = ("No Promo", "Black Friday")[i % 2]
        rows.append(("Bikes", price, 100 - 2 * price + (15 if event != "No Promo" else 0), 5.0 * (100 - 2 * price), event))
    rows += [("Thin", 5.0, 1.0, 1.0, "No Promo")] * 3
    df = spark.createDataFrame(rows, "CategoryName string, ProductPrice double, OrderQuantity double, profit double, event string")
    promo = {r.event: r for r in pricing.fit_promo(df).collect()}
    assert set(promo) == {"No Promo", "Black Friday"}
    assert promo["No Promo"].slope == pytest.approx(-2, abs=0.01)
    assert promo["Black Friday"].intercept - promo["No Promo"].intercept == pytest.approx(15, abs=0.2)
    curves = pricing.fit_demand_curves(df.filter("CategoryName = 'Bikes'"))
    at = curves.select(*[pricing.demand_at(F.lit(p)).alias(f"q{i}") for i, p in enumerate((12.0, 20.0, 30.0))]).first()
    assert list(at) == pytest.approx([76.0, 60.0, 40.0], abs=0.5)
    low = pricing.fit_demand_curves(df.filter("CategoryName = 'Bikes'"), 0.1, event=None, rounds=3).select(pricing.demand_at(F.lit(20.0))).first()[0]
    high = pricing.fit_demand_curves(df.filter("CategoryName = 'Bikes'"), 0.9, event=None, rounds=3).select(pricing.demand_at(F.lit(20.0))).first()[0]
    assert low < 67.5 < high


def test_expectile_levels_are_fitted_together(spark):
    """All levels at once: ordered curves, zero equations, shares of weight on both sides; a few categories, one of them hot."""
    rng = np.random.default_rng(3)
    rows = [("Hot" if i % 10 else "Cold", float(10 + i % 40), float(100 - 2 * (i % 40) + rng.gamma(2, 10)), "No Promo") for i in range(3000)]
    rows += [("One", 5.0, 7.0, "No Promo"), ("Null", None, 1.0, "No Promo"), (None, 1.0, 1.0, "No Promo"), ("Hot", 1.0, 1e6, "Sale")]
    df = spark.createDataFrame(rows, "CategoryName string, ProductPrice double, OrderQuantity double, event string").repartition(4)
    curves = pricing.fit_expectile_curves(df, (0.1, 0.5, 0.9)).cache()
    assert curves.count() == 9 and all(r.converged and r.rounds < 100 for r in curves.collect())
    facts = pricing.curve_equations(df, curves).collect()
    assert all(r.residual < 1e-7 for r in facts) and {r["rows"] for r in facts if r.CategoryName == "Cold"} == {300}
    at = {(r.CategoryName, r.level): r.y for r in curves.select("CategoryName", "level", pricing.demand_at(F.lit(25.0)).alias("y")).collect()}
    assert at["Hot", 0.1] + 5 < at["Hot", 0.5] < at["Hot", 0.9] - 5
    spoiled = curves.withColumn("coefficients", F.transform("coefficients", lambda x: x * 1.01))
    assert all(r.residual > 1e-4 for r in pricing.curve_equations(df, spoiled).collect() if r.CategoryName != "One")
    assert pricing.fit_expectile_curves(df.limit(0)).collect() == []


def test_partial_autocorrelation_of_an_ar1(spark):
    acf = spark.createDataFrame([(k, 0.6**k) for k in range(6)], "lag int, acf double")
    got = [r.pacf for r in profile.partial_autocorrelation(acf, 4).orderBy("lag").collect()]
    assert got == pytest.approx([0.6, 0, 0, 0], abs=1e-12)


def test_boosted_model_and_folds(tiny_panel):
    table = panels.feature_table(tiny_panel).cache()
    folds = panels.time_folds(table, 3)
    sizes = folds.groupBy("fold", "role").count().collect()
    n = table.count()
    assert {(r.fold, r["count"]) for r in sizes if r.role == "test"} == {(1, n // 4), (2, n // 4), (3, n // 4)}
    model = evaluate.demand_model(table, ["lag_1", "lag_7"], "OrderQuantity", maxIter=3)
    rows = evaluate.permutation_importance(model, table, ["lag_1", "lag_7"], "OrderQuantity").collect()
    assert {r.feature for r in rows} == {"lag_1", "lag_7"} and max(r.rmse_increase for r in rows) > 0


def test_expanding_fits_equal_each_fold_apart(spark, tiny_panel):
    table = panels.feature_table(tiny_panel, log_target=False).withColumn("one", F.lit(1.0)).cache()
    features = ["one", "is_weekend", "lag_1"]
    folds = panels.time_folds(table, 3).toPandas()
    got = evaluate.expanding_fits(panels.time_blocks(table, 3), features, "OrderQuantity", [0.0, 2.0]).collect()
    assert {(r.fold, r.ridge) for r in got} == {(k, x) for k in (1, 2, 3) for x in (0.0, 2.0)}
    for r in got:
        part = folds[folds.fold == r.fold]
        (x, y), (tx, ty) = ((p[features].to_numpy(float), p.OrderQuantity.to_numpy(float)) for _, p in sorted(part.groupby("role"), reverse=True))
        beta = np.linalg.solve(x.T @ x + r.ridge * np.eye(3), x.T @ y)
        assert r.coefficients == pytest.approx(beta.tolist(), abs=1e-7) and (r.n_train, r.n_test) == (len(x), len(tx))
        assert r.rmse == pytest.approx(np.sqrt(np.mean((ty - tx @ beta) ** 2)), rel=1e-7)
    assert evaluate.expanding_fits(panels.time_blocks(table.limit(0), 3), features, "OrderQuantity").collect() == []
    assert [r.block for r in panels.time_blocks(table.limit(2), 3).collect()] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permuted_is_a_bijection(spark, n):
    def order(seed):
        return [r.p for r in spark.range(n).select("id", ordering.permuted(F.col("id"), F.lit(n).cast("long"), seed).alias("p")).orderBy("id").collect()]

    assert sorted(order(3)) == list(range(n)) and order(3) == order(3)
    assert n < 7 or order(3) != order(4)
    assert n < 1000 or abs(np.corrcoef(order(3), np.arange(n))[0, 1]) < 0.15


def test_donors_number_the_rows_once(spark):
    df = spark.createDataFrame([(i, i * 2.0, f"s{i}") for i in range(50)], "k int, v double, s string")
    paired = ordering.with_donors(df, ["k"], ["v", "s"], 11, repeats=2)
    assert str(paired._jdf.queryExecution().optimizedPlan()).count("Window") == 0
    rows = paired.collect()
    for repeat in (1, 2):
        some = [r for r in rows if r._repeat == repeat]
        assert sorted(r.k for r in some) == list(range(50)) and sorted(r._donor.v for r in some) == [i * 2.0 for i in range(50)]
        assert all(r._donor.s == f"s{int(r._donor.v / 2)}" for r in some)
    assert ordering.with_donors(df.limit(0), ["k"], ["v"], 11).collect() == []


def test_correlation_of_many_items_in_blocks(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(1e6, 3.0, (23, 30)), columns=[f"i{j}" for j in range(30)])
    wide["i4"], wide.index.name = 7.0, "month"
    long = wide.reset_index().melt("month", var_name="item", value_name="units")
    long = long[rng.random(len(long)) > 0.15]
    long = pd.concat([long, pd.DataFrame({"month": [99], "item": ["lone"], "units": [1.0]})])
    df = spark.createDataFrame(long).union(spark.createDataFrame([(None, "i1", 1.0), (1, None, 1.0), (200, "i1", None)], "month long, item string, units double"))
    got = {(r.item_a, r.item_b): r.correlation for r in profile.correlation_matrix(df, "item", "units", block=8, chunk=5).collect()}
    assert len(got) == 30 * 30 + 1
    expected = long.pivot(index="month", columns="item", values="units").corr(min_periods=2)
    for (a, b), value in got.items():
        e = expected.loc[a, b]
        assert value is None if np.isnan(e) else value == pytest.approx(e, abs=1e-9)
    assert profile.correlation_matrix(df.limit(0), "item", "units").collect() == []


def test_fallback_order(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, 3.0), (None, 2.0, 3.0)], "AutoARIMA double, Prophet double, ColdStart double")
    got = [(r.pred, r.method_used) for r in forecast.with_fallback(df, ["AutoARIMA", "Prophet", "ColdStart"]).collect()]
    assert got == [(1.0, "AutoARIMA"), (3.0, "ColdStart"), (2.0, "Prophet")]


def test_full_buckets_are_cut_until_they_are_small(spark, monkeypatch):
    """Values that share every first bucket, repeated values, infinities, null keys: cut in rounds, exact all the same."""
    monkeypatch.setattr(ordering, "FULL", 5)
    rng = np.random.default_rng(4)
    rows = [("near", 1e9 + float(v)) for v in rng.integers(0, 3000, 3000)] + [("same", 3.5)] * 500
    rows += [(None, float(v)) for v in rng.normal(0, 1e-7, 200)] + [("wide", v) for v in (float("-inf"), -1e300, 0.0, 5e-324, 1e300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r.k: list(r)[1:] for r in ordering.quantiles(df, "v", probs, ["k"]).collect()}
    for k in ("near", "same", None):
        assert got[k] == pytest.approx(list(np.quantile([v for name, v in rows if name == k], probs)), rel=1e-12), k
    assert got["wide"][2] == 0.0 and got["wide"][4] == 1e300


def test_quantiles_without_keys_run_no_job_early(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bounds", "bounds")
    try:
        df = spark.createDataFrame([(float(v),) for v in range(1001)], "v double")
        trimmed = clean.trim_tails(df, "v", 0.01, 0.99)
        assert len(tracker.getJobIdsForGroup("bounds")) == 0
        assert sorted(r.v for r in trimmed.collect()) == [float(v) for v in range(10, 991)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert clean.trim_tails(df.limit(0), "v").collect() == []
    assert clean.trim_top(df, "v", 0.5).count() == 501
