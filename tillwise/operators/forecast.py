"""Daily sales and returns forecasts per item (long form: item, date, quantity)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.functions import dates
from tillwise.functions.numeric import clip, ratio
from tillwise.operators.panel import DAY, ITEM, QTY, lagged_sales, tail_rows
from tillwise.operators.regress import dot, least_squares

# Labels reported next to each forecast.
SALES_CONFIDENCE = {
    "AutoARIMA": "High (90-95%)",
    "Prophet": "Medium-High (80-85%)",
    "ColdStart": "Low (60-65%)",
}
RETURNS_CONFIDENCE = {"AutoARIMA": "95.0%", "Prophet": "85.0%", "ColdStart": "65.0%"}


def _labels(table: dict[str, str], method: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, label in table.items():
        out = out.when(method == name, label)
    return out


def _future(panel: DataFrame, items: DataFrame, horizon: int, day: str) -> DataFrame:
    """The next ``horizon`` dates for every row of ``items``."""
    newest = panel.agg(F.max(day)).scalar()
    return items.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "date", F.date_add(newest, F.col("step"))
    )


def cold_start(panel: DataFrame, horizon: int = 30) -> DataFrame:
    """Median of the last 30 days times a capped 7/14-day momentum, held constant.

    The panel is dense, so the last 30 rows are the last 30 days: older days are
    cut by date before anything is grouped.
    """
    newest = panel.agg(F.max(DAY)).scalar()
    age = F.datediff(newest, F.col(DAY))
    recent = panel.filter(F.col(DAY) > F.date_sub(newest, 30)).groupBy(ITEM).agg(
        F.avg(F.when(age < 7, F.col(QTY))).alias("short"),
        F.avg(F.when(age < 14, F.col(QTY))).alias("long"),
        F.median(QTY).alias("base"),
    )
    momentum = clip(
        F.when(F.col("long") > 0, F.col("short") / F.col("long")).otherwise(F.lit(1.0)), 0.8, 1.2
    )
    level = recent.select(ITEM, (F.col("base") * momentum).alias("yhat"))
    return _future(panel, level, horizon, DAY).select(ITEM, "date", "yhat")


def fit_autoregression(panel: DataFrame, value: str = QTY, day: str = DAY, exog: Sequence[str] = ()) -> DataFrame:
    """Weekly seasonal autoregression per item: intercept, lag 1, lag 7 and regressors."""
    by_item = W.partitionBy(ITEM).orderBy(day)
    rows = panel.select(
        ITEM,
        F.lit(1.0).alias("one"),
        F.lag(value, 1).over(by_item).alias("lag_1"),
        F.lag(value, 7).over(by_item).alias("lag_7"),
        *exog,
        F.col(value).alias("y"),
    )
    return least_squares(rows, [ITEM], ["one", "lag_1", "lag_7", *exog], "y")


def autoregression_forecast(
    models: DataFrame,
    panel: DataFrame,
    horizon: int = 30,
    value: str = QTY,
    day: str = DAY,
    exog: DataFrame | None = None,
) -> DataFrame:
    """Roll the fitted recursion forward over a seven-value history array.

    ``exog`` optionally holds (item, array of ``horizon`` regressor values).
    """
    history = (
        tail_rows(panel, 7, day)
        .groupBy(ITEM)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_age", F.col(value).cast("double").alias("v"))), False),
                lambda s: s["v"],
            ).alias("seen")
        )
        .filter(F.size("seen") == 7)
    )
    state = models.join(history, ITEM)
    if exog is not None:
        state = state.join(exog, ITEM)
        outside = lambda step: F.get("coefficients", F.lit(3)) * F.get("exog", step - 1)
    else:
        outside = lambda step: F.lit(0.0)
    c = [F.get("coefficients", F.lit(i)) for i in range(3)]

    def advance(seen: Column, step: Column) -> Column:
        after = c[0] + c[1] * F.get(seen, F.size(seen) - 1) + c[2] * F.get(seen, F.size(seen) - 7) + outside(step)
        return F.concat(seen, F.array(after))

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("seen"), advance)
    newest = panel.agg(F.max(day)).scalar()
    return (
        state.select(ITEM, F.posexplode(F.slice(rolled, 8, horizon)).alias("pos", "yhat"))
        .select(ITEM, F.date_add(newest, F.col("pos") + 1).alias("date"), "yhat")
    )


def season_columns(day: Column, origin: Column, yearly: int = 3, weekly: int = 3) -> list[tuple[str, Column]]:
    """Constant, linear trend and Fourier pairs for the week and the year."""
    t = F.datediff(day, origin).cast("double")
    out = [("one", F.lit(1.0)), ("trend", t / F.lit(365.0))]
    for prefix, period, order in (("w", 7.0, weekly), ("y", 365.25, yearly)):
        for k in range(1, order + 1):
            angle = t * F.lit(2 * math.pi * k / period)
            out += [(f"{prefix}s{k}", F.sin(angle)), (f"{prefix}c{k}", F.cos(angle))]
    return out


# Calendar day zero of trend and seasons; only relative phases matter.
_ORIGIN = "1970-01-05"


def fit_seasonal(
    panel: DataFrame,
    value: str = QTY,
    day: str = DAY,
    regressors: dict[str, Column] | None = None,
    min_total: float = 5,
    yearly: int = 3,
    weekly: int = 3,
    ridge: float = 1e-3,
) -> DataFrame:
    """Trend + seasonality + regressors per item; items with too little volume are skipped."""
    columns = season_columns(F.col(day), F.lit(_ORIGIN).cast("date"), yearly, weekly)
    extra = list((regressors or {}).items())
    rows = panel.select(
        ITEM, *[c.alias(n) for n, c in columns], *[c.cast("double").alias(n) for n, c in extra], F.col(value).alias("y")
    )
    enough = panel.groupBy(ITEM).agg(F.sum(value).alias("_s")).filter(F.col("_s") >= min_total).select(ITEM)
    names = [n for n, _ in columns] + [n for n, _ in extra]
    return least_squares(rows.join(enough, ITEM, "left_semi"), [ITEM], names, "y", [0.0] + [ridge] * (len(names) - 1))


def seasonal_forecast(
    models: DataFrame,
    panel: DataFrame,
    horizon: int = 30,
    day: str = DAY,
    regressors: dict[str, Column] | None = None,
    exog: DataFrame | None = None,
    yearly: int = 3,
    weekly: int = 3,
) -> DataFrame:
    """Evaluate the seasonal model on the future dates; what must not be negative is floored by the caller.

    ``regressors`` are expressions of the future ``date``; ``exog`` holds one
    array of ``horizon`` values per item for a trailing regressor.
    """
    columns = season_columns(F.col("date"), F.lit(_ORIGIN).cast("date"), yearly, weekly)
    if exog is not None:
        models = models.join(exog, ITEM)
    future = _future(panel, models, horizon, day)
    x = [c for _, c in columns] + [c.cast("double") for c in (regressors or {}).values()]
    if exog is not None:
        x.append(F.get("exog", F.col("step") - 1))
    return future.select(ITEM, "date", dot(F.col("coefficients"), x).alias("yhat"))


def payday_regressor(day: Column) -> dict[str, Column]:
    return {"is_payday": dates.is_payday(day).cast("double")}


def prefer_trained(forecasts: dict[str, DataFrame], fallback: DataFrame) -> DataFrame:
    """Each item's forecast from the first method that has one, else cold start; a NULL or NaN is no forecast."""
    stacked = fallback.withColumn("model_source", F.lit("ColdStart")).withColumn("_order", F.lit(len(forecasts)))
    for order, (method, frame) in enumerate(forecasts.items()):
        usable = frame.filter(F.col("yhat").isNotNull() & ~F.isnan("yhat"))
        part = usable.withColumn("model_source", F.lit(method)).withColumn("_order", F.lit(order))
        stacked = stacked.unionByName(part)
    best = F.min("_order").over(W.partitionBy(ITEM))
    return stacked.withColumn("_best", best).filter(F.col("_order") == F.col("_best")).drop("_order", "_best")


def dispatch(forecasts: dict[str, DataFrame], fallback: DataFrame, round_to: int = 2) -> DataFrame:
    """Trained forecasts where they exist, cold start elsewhere, with labels.

    Returns (item, model_source, confidence_level, date, qty) with quantities
    rounded half-even and floored at zero.
    """
    return prefer_trained(forecasts, fallback).select(
        ITEM,
        "model_source",
        _labels(SALES_CONFIDENCE, F.col("model_source")).alias("confidence_level"),
        "date",
        F.greatest(F.bround("yhat", round_to), F.lit(0.0)).alias("qty"),
    )


def forecast_documents(daily: DataFrame) -> DataFrame:
    """One nested row per item: method, confidence, date->quantity map and total."""
    return daily.groupBy(F.col(ITEM).cast("string").alias("item_id"), "model_source", "confidence_level").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("date").cast("string"), "qty")))
        ).alias("daily_forecast"),
        F.sum("qty").alias("total_horizon_volume"),
    )


def documents_to_daily(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("item_id").alias(ITEM),
        "model_source",
        "confidence_level",
        F.explode("daily_forecast").alias("date", "qty"),
    ).withColumn("date", F.to_date("date"))


def future_sales(panel: DataFrame, sales_forecast: DataFrame, horizon: int = 30) -> DataFrame:
    """First ``horizon`` forecast quantities per item, padded with the item's mean sales.

    Result: (item, exog array of ``horizon`` doubles).
    """
    order = W.partitionBy(ITEM).orderBy("date")
    ranked = sales_forecast.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= horizon)
    known = ranked.groupBy(ITEM).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("step", F.col("qty").cast("double").alias("v")))), lambda s: s["v"]
        ).alias("known")
    )
    means = panel.groupBy(ITEM).agg(F.avg(QTY).alias("mean_sales"))
    empty = F.array().cast("array<double>")
    return (
        means.join(known, ITEM, "left")
        .withColumn("known", F.coalesce("known", empty))
        .select(
            ITEM,
            F.concat(
                F.col("known"), F.array_repeat(F.col("mean_sales"), F.lit(horizon) - F.size("known"))
            ).alias("exog"),
        )
    )


def cold_start_returns(panel: DataFrame, sales_ahead: DataFrame) -> DataFrame:
    """Recent returns scaled by expected sales, day by day.

    Both averages use the last 15 days; no recent sales counts as one unit a day.
    """
    newest = panel.agg(F.max("ReturnDate")).scalar()
    recent = panel.filter(F.col("ReturnDate") > F.date_sub(newest, 15)).groupBy(ITEM).agg(
        F.avg("ReturnQuantity").alias("returns_mean"), F.avg(QTY).alias("sales_mean")
    )
    base = F.when(F.col("sales_mean") > 0, F.col("sales_mean")).otherwise(F.lit(1.0))
    return recent.join(sales_ahead, ITEM).select(
        ITEM,
        F.posexplode("exog").alias("pos", "sale"),
        F.col("returns_mean"),
        base.alias("base"),
    ).select(
        ITEM,
        F.date_add(newest, F.col("pos") + 1).alias("date"),
        (F.col("returns_mean") * F.col("sale") / F.col("base")).alias("yhat"),
    )


def returns_summary(daily: DataFrame) -> DataFrame:
    """Total returns per item over the horizon, as whole units, with confidence."""
    return daily.groupBy(ITEM, "model_source").agg(
        F.sum("yhat").alias("total"), F.min("date").alias("Forecast_Start"), F.max("date").alias("Forecast_End")
    ).select(
        ITEM,
        F.bround(F.greatest("total", F.lit(0.0)), 0).cast("int").alias("Predicted_Returns_Total"),
        _labels(RETURNS_CONFIDENCE, F.col("model_source")).alias("Confidence_Rating"),
        F.col("model_source").alias("Model_Used"),
        "Forecast_Start",
        "Forecast_End",
    )


def returns_validation(
    panel: DataFrame,
    start: str,
    end: str,
    routes: DataFrame | None = None,
    model_totals: DataFrame | None = None,
    scaled: bool = False,
) -> DataFrame:
    """Predicted against actual returns of one month with bounds and confidence.

    Cold start uses the last 30 days before ``start`` (``scaled=True``: the last
    15, multiplied by the change of mean sales). ``model_totals`` may supply
    (item, pred, lower, upper) for items routed to a trained model.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    window = 15 if scaled else 30
    month = panel.filter(F.col("ReturnDate").between(first, last)).groupBy(ITEM).agg(
        F.sum("ReturnQuantity").alias("actual"), F.avg(QTY).alias("sales_now")
    )
    before = panel.filter(F.col("ReturnDate") < first)
    history = before.groupBy(ITEM).agg(F.avg(QTY).alias("sales_before"))
    recent = before.filter(F.col("ReturnDate") >= F.date_sub(first, window)).groupBy(ITEM).agg(
        F.avg("ReturnQuantity").alias("m"), F.stddev_samp("ReturnQuantity").alias("s"), F.count(F.lit(1)).alias("k")
    )
    df = panel.select(ITEM).distinct().join(month, ITEM, "left").join(history, ITEM, "left").join(recent, ITEM, "left")
    if scaled:
        factor = ratio(F.coalesce("sales_now", "sales_before"), F.col("sales_before"))
        pred = F.col("m") * factor * 30
        spread = F.when(F.col("k") > 1, F.col("s")).otherwise(F.lit(0.1))
        margin = F.lit(1.96 / math.sqrt(15) * 30) * spread * factor
    else:
        pred = F.col("m") * 30
        sem = F.when((F.col("k") > 1) & (F.col("s") > 0), F.col("s") / F.sqrt("k")).otherwise(F.lit(0.1))
        margin = F.lit(1.96 * 30) * sem
    df = df.select(
        ITEM,
        F.coalesce("actual", F.lit(0)).alias("Actual_Return"),
        F.coalesce(pred, F.lit(0.0)).alias("_p"),
        F.coalesce(pred - margin, F.lit(0.0)).alias("_l"),
        F.coalesce(pred + margin, F.lit(0.0)).alias("_u"),
        F.lit("ColdStart").alias("Return_Model"),
    )
    if routes is not None and model_totals is not None:
        trained = model_totals.join(routes.select(ITEM, "TargetModel"), ITEM)
        df = df.join(trained, ITEM, "left").select(
            ITEM,
            "Actual_Return",
            F.coalesce("pred", "_p").alias("_p"),
            F.coalesce("lower", "_l").alias("_l"),
            F.coalesce("upper", "_u").alias("_u"),
            F.coalesce("TargetModel", "Return_Model").alias("Return_Model"),
        )
    zero = F.lit(0.0)
    p = F.bround(F.greatest("_p", zero), 0)
    low = F.bround(F.greatest("_l", zero), 0)
    high = F.bround("_u", 0) if scaled else F.when(p > 0, F.bround(F.least(p * 3, F.col("_u")), 0)).otherwise(F.bround("_u", 0))
    width = (high - low) / (p + 1)
    conf = clip(F.lit(100.0) * (F.lit(1.0) - width / (4 if scaled else 2)), 0.0, 100.0)
    return df.select(
        ITEM,
        F.col("Actual_Return").cast("long").alias("Actual_Return"),
        p.cast("long").alias("Predicted_Returns"),
        low.cast("long").alias("Lower_Bound"),
        high.cast("long").alias("Upper_Bound"),
        F.when(p > 0, F.bround(conf, 2)).otherwise(zero).alias("Confidence_Rating"),
        "Return_Model",
    )


def with_fallback(predictions: DataFrame, order: Sequence[str]) -> DataFrame:
    """First available prediction among per-method columns, and which one it was."""
    used = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order])
    return predictions.withColumn("pred", F.coalesce(*order)).withColumn("method_used", used)
