"""Sales and returns forecasting from the dense panel to the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.operators import clean, evaluate, forecast, inventory, joins, panel as panels, routing
from tillwise.operators.panel import DAY, ITEM, QTY
from tillwise.session import cut_lineage


def gather_panel(
    sales: DataFrame,
    products: DataFrame,
    subcategories: DataFrame,
    cutoff: str | None = "2016-08-01",
    window_days: int = 365,
) -> DataFrame:
    """Cleaned tables to the dense panel of the last ``window_days``.

    Routing, training and forecasting all read the panel, so it is written once
    (reliable checkpoint) instead of being recomputed from the sale lines.
    """
    recent = sales if cutoff is None else clean.since(sales, DAY, cutoff)
    earliest = recent.agg(F.min("StockDate")).scalar()
    lines = clean.trailing_days(recent, DAY, window_days)
    items = joins.product_items(products, subcategories)
    daily = joins.daily_by_item(lines, items, DAY, [QTY], ["StockDate"])
    return cut_lineage(panels.sales_panel(daily, subcategories, earliest))


def train_sales(panel: DataFrame, policy: routing.Policy = routing.SALES_POLICY) -> dict[str, DataFrame]:
    """Route items and fit the models of the two trained routes.

    Routes and coefficients are small artifacts read by several later steps, so
    they are written once.
    """
    routes = cut_lineage(routing.route(routing.metrics(panel), policy).select(ITEM, "TargetModel"))

    def routed(method: str) -> DataFrame:
        return panel.join(routes.filter(F.col("TargetModel") == method), ITEM, "left_semi")

    seasonal = forecast.fit_seasonal(routed("Prophet"), regressors=forecast.payday_regressor(F.col(DAY)))
    return {
        "routes": routes,
        "AutoARIMA": cut_lineage(forecast.fit_autoregression(routed("AutoARIMA"))),
        "Prophet": cut_lineage(seasonal),
    }


def sales_forecast(panel: DataFrame, models: dict[str, DataFrame] | None = None, horizon: int = 30) -> DataFrame:
    """Daily forecast per item; pass saved ``models`` to skip training."""
    models = models or train_sales(panel)
    paths = {
        "AutoARIMA": forecast.autoregression_forecast(models["AutoARIMA"], panel, horizon),
        "Prophet": forecast.seasonal_forecast(
            models["Prophet"], panel, horizon, regressors=forecast.payday_regressor(F.col("date"))
        ),
    }
    return forecast.dispatch(paths, forecast.cold_start(panel, horizon))


def sales_reports(panel: DataFrame, daily: DataFrame, horizon: int = 30) -> dict[str, DataFrame]:
    """Stocking report, staffing benchmark, alerts and calendar."""
    load = inventory.forecast_load(daily)
    benchmark = inventory.staffing_benchmark(panel)
    return {
        "stocking": inventory.stocking_report(daily, horizon),
        "benchmark": benchmark,
        "alerts": inventory.staffing_alerts(load, benchmark),
        "calendar": inventory.staffing_calendar(load),
    }


def returns_forecast(panel: DataFrame, sales_daily: DataFrame, horizon: int = 30) -> DataFrame:
    """Expected returns per item, driven by the sales forecast."""
    metrics = routing.metrics(panel, "ReturnQuantity", "ReturnDate", None)
    routes = cut_lineage(routing.route(metrics, routing.RETURNS_POLICY).select(ITEM, "TargetModel"))
    ahead = cut_lineage(forecast.future_sales(panel, sales_daily, horizon))
    lagged = panels.lagged_sales(panel)

    def routed(method: str) -> DataFrame:
        return lagged.join(routes.filter(F.col("TargetModel") == method), ITEM, "left_semi")

    seasonal = forecast.fit_seasonal(
        routed("Prophet"), "ReturnQuantity", "ReturnDate", {"OrderQuantity_Lag1": F.col("OrderQuantity_Lag1")}, min_total=0
    )
    recursive = forecast.fit_autoregression(
        routed("AutoARIMA"), "ReturnQuantity", "ReturnDate", ["OrderQuantity_Lag1"]
    )
    paths = {
        "AutoARIMA": forecast.autoregression_forecast(
            cut_lineage(recursive), panel, horizon, "ReturnQuantity", "ReturnDate", ahead
        ),
        "Prophet": forecast.seasonal_forecast(cut_lineage(seasonal), panel, horizon, "ReturnDate", exog=ahead),
    }
    return forecast.returns_summary(forecast.prefer_trained(paths, forecast.cold_start_returns(panel, ahead)))


def evaluate_with_fallback(panel: DataFrame, days: int = 30) -> DataFrame:
    """Hold out the last days; each item uses the first method that could be fitted."""
    split = panels.split_last_days(panel, days)
    train, test = split.filter("part = 'train'").drop("part"), split.filter("part = 'test'").drop("part")
    models = train_sales(train)
    ar = forecast.autoregression_forecast(models["AutoARIMA"], train, days).withColumnRenamed("yhat", "AutoARIMA")
    seasonal = forecast.seasonal_forecast(
        models["Prophet"], train, days, regressors=forecast.payday_regressor(F.col("date"))
    ).withColumnRenamed("yhat", "Prophet")
    cold = panels.walk_forward_mean(panel, QTY).select(ITEM, F.col(DAY).alias("date"), F.col("ColdStart_Pred").alias("ColdStart"))
    scored = (
        test.select(ITEM, F.col(DAY).alias("date"), F.col(QTY).alias("actual"))
        .join(ar, [ITEM, "date"], "left")
        .join(seasonal, [ITEM, "date"], "left")
        .join(cold, [ITEM, "date"], "left")
    )
    chosen = forecast.with_fallback(scored, ["AutoARIMA", "Prophet", "ColdStart"])
    return evaluate.error_metrics(chosen, [ITEM, "method_used"]).select(ITEM, "method_used", "n", "rmse", "smape")
