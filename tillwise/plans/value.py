"""Customer value, marketing, basket and price analyses end to end."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tillwise.operators import basket, customer, joins, marketing, pricing
from tillwise.session import cut_lineage


def customer_plan(
    sales: DataFrame, products: DataFrame, customers: DataFrame, many: float = 5, rich: float = 1000
) -> DataFrame:
    """Score, segment and impute all repeat buyers and attach a strategy.

    The per-customer summary is read by two fits, a clustering and the scoring,
    so it is written once.
    """
    summary = cut_lineage(customer.purchase_summary(customer.transactions(sales, products)))
    groups = customer.outlier_groups(summary, many, rich)
    core = groups["core"]
    scored = customer.score(core, customer.fit_frequency_model(core), customer.fit_spend_model(core))
    segmented = customer.assign_segments(scored, customer.fit_segments(core))
    everyone = customer.combine(segmented, customer.outlier_segments(summary, many, rich))
    filled = customer.financial_columns(customer.impute_chained(everyone))
    return customer.with_strategies(joins.look_up(filled, customer.demographics(customers), [customer.ID]))


def channel_plan(weekly: DataFrame, rates: Mapping[str, float] = marketing.CARRY_OVER) -> dict[str, DataFrame]:
    """Weekly channel table to weights, ROI, waterfall and budget strategies."""
    table = cut_lineage(marketing.feature_table(weekly, rates))
    weights = cut_lineage(marketing.fit_weights(table))
    by_channel = weights.filter(F.col("feature").isin(*rates)).select(
        F.col("feature").alias("channel"), F.col("coefficient").alias("weight")
    )
    carried = marketing.adstock(marketing.to_long(weekly, list(rates)), rates)
    predicted = marketing.predict(table, weights).agg(F.sum("pred")).scalar()
    roi = marketing.roi_table(carried, by_channel)
    budgets = weekly.sparkSession.createDataFrame([(15000.0,), (20000.0,)], "budget double")
    return {
        "weights": weights,
        "roi": roi,
        "waterfall": marketing.waterfall(carried, by_channel, predicted, list(rates)),
        "budgets": marketing.budget_strategies(budgets),
    }


def basket_plan(
    sales: DataFrame, products: DataFrame, subcategories: DataFrame, min_support: float = 0.01,
    min_confidence: float = 0.3, min_lift: float = 1.0,
) -> dict[str, DataFrame]:
    """Sale lines to itemsets, rules and the significant rules."""
    lines = joins.enrich_sales(sales.select("OrderNumber", "ProductKey"), products, subcategories)
    itemsets = cut_lineage(basket.frequent_itemsets(basket.baskets(lines, min_support=min_support), min_support))
    rules = basket.rules(itemsets)
    return {
        "itemsets": itemsets,
        "rules": rules,
        "significant": basket.significant_rules(rules, min_confidence, min_lift),
    }


def price_plan(events: DataFrame) -> dict[str, DataFrame]:
    """Price events to the performance table, profit curves and best prices."""
    curves = cut_lineage(pricing.fit_demand_curves(events))
    profit = pricing.optimise_prices(events, curves)
    return {
        "performance": pricing.performance_table(events, cut_lineage(pricing.fit_promo(events))),
        "curves": profit,
        "best": pricing.best_price(profit),
    }
