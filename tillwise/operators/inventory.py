"""Stocking, staffing and growth tables derived from forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions import dates
from tillwise.functions.numeric import ratio, zero_as_one
from tillwise.operators.panel import DAY, ITEM, QTY


def stocking_report(daily: DataFrame, horizon: int = 30) -> DataFrame:
    """Expected demand and safety stock per item.

    Trained methods hold 15 % of volume, at most half the horizon at the median
    day; cold starts hold 15 %, or 30 % when the forecast itself varies a lot.
    """
    stats = daily.groupBy(ITEM, "model_source").agg(
        F.sum("qty").alias("total"),
        F.median("qty").alias("mid"),
        F.avg("qty").alias("mean"),
        F.stddev_pop("qty").alias("sd"),
    )
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(F.lit(0.0))
    cold = F.col("model_source") == "ColdStart"
    safety = F.when(cold, F.col("total") * F.when(cv > 0.5, 0.3).otherwise(0.15)).otherwise(
        F.least(F.col("total") * 0.15, F.col("mid") * (horizon / 2))
    )
    return stats.select(
        F.col(ITEM).cast("string").alias("item_id"),
        F.bround("total", 2).alias("forecasted_sales_total"),
        F.bround(safety, 2).alias("safety_stock_estimate"),
        F.bround(F.col("total") + safety, 2).alias("total_stock_recommendation"),
        F.col("model_source").alias("model_used"),
        F.when(cold, "Volatility-Adjusted").otherwise("Error-Adjusted").alias("stock_logic"),
    )


def forecast_load(daily: DataFrame) -> DataFrame:
    """Units per future day over all items."""
    return daily.groupBy("date").agg(F.sum("qty").alias("units"))


def staffing_benchmark(panel: DataFrame) -> DataFrame:
    """Mean daily load of the last 30 days and of the same month a year ago.

    Last year is used when it exceeds 70 % of the recent level. One row.
    """
    newest = panel.agg(F.max(DAY)).scalar()
    totals = panel.filter(F.col(DAY) >= F.date_sub(newest, 335)).groupBy(DAY).agg(F.sum(QTY).alias("units"))
    age = F.datediff(newest, F.col(DAY))
    both = totals.agg(
        F.avg(F.when(age < 30, F.col("units"))).alias("prev_month"),
        F.coalesce(F.avg(F.when(age.between(305, 335), F.col("units"))), F.lit(0.0)).alias("last_year"),
    )
    seasonal = F.col("last_year") > F.col("prev_month") * 0.7
    return both.select(
        "prev_month",
        "last_year",
        F.when(seasonal, F.col("last_year")).otherwise(F.col("prev_month")).alias("benchmark"),
        F.when(seasonal, "Same Month Prev Year").otherwise("Prev Month Average").alias("benchmark_name"),
    )


def staffing_alerts(load: DataFrame, benchmark: DataFrame, factor: float = 1.2) -> DataFrame:
    """Future days above ``factor`` times the benchmark."""
    level = benchmark.select("benchmark").scalar()
    return load.withColumn("benchmark", level).filter(F.col("units") > F.col("benchmark") * factor)


def staffing_calendar(load: DataFrame) -> DataFrame:
    """Week-of-month x weekday matrix of mean units (missing cells are 0)."""
    return (
        load.select(
            dates.week_of_month(F.col("date")).alias("Week"),
            F.weekday("date").alias("_dow"),
            "units",
        )
        .groupBy("Week")
        .pivot("_dow", list(range(7)))
        .agg(F.avg("units"))
        .na.fill(0.0)
        .select("Week", *[F.col(f"`{i}`").alias(d) for i, d in enumerate(dates.WEEKDAYS)])
    )


def peak_days(load: DataFrame, sigmas: float | None = 1.5, factor: float | None = None) -> DataFrame:
    """Days above mean + ``sigmas`` sample deviations, or above ``factor`` x mean."""
    stats = load.agg(F.struct(F.avg("units").alias("m"), F.stddev_samp("units").alias("s"))).scalar()
    limit = (
        stats.getField("m") * factor
        if factor is not None
        else stats.getField("m") + F.lit(sigmas) * stats.getField("s")
    )
    return load.filter(F.col("units") > limit).select(
        "date", "units", dates.weekday_label(F.col("date")).alias("weekday")
    )


def backtest_table(scored: DataFrame, z: float = 1.65, scale_by_days: bool = True, keys: tuple[str, ...] = (ITEM,)) -> DataFrame:
    """Month totals of actual and predicted with RMSE-based stock level and accuracy.

    ``scored`` is (keys, actual, pred) per day; predictions are floored at zero
    and rounded to whole units first.
    """
    whole = scored.withColumn("_p", F.bround(F.greatest(F.col("pred").cast("double"), F.lit(0.0)), 0))
    sums = whole.groupBy(*keys).agg(
        F.sum("actual").cast("long").alias("Actual_Month_Sales"),
        F.sum("_p").cast("long").alias("Predicted_Month_Sales"),
        F.sqrt(F.avg((F.col("actual") - F.col("pred")) * (F.col("actual") - F.col("pred")))).alias("rmse"),
        F.count(F.lit(1)).alias("days"),
    )
    room = F.lit(z) * F.col("rmse") * (F.sqrt("days") if scale_by_days else F.lit(1.0))
    gap = F.abs(F.col("Actual_Month_Sales") - F.col("Predicted_Month_Sales"))
    ape = F.coalesce(ratio(gap, F.col("Actual_Month_Sales")), F.lit(0.0))
    return sums.select(
        *keys,
        "Actual_Month_Sales",
        "Predicted_Month_Sales",
        F.bround(F.col("Predicted_Month_Sales") + room, 0).cast("long").alias("Safety_Stock_Level"),
        (F.least(F.greatest(F.lit(1.0) - ape, F.lit(0.0)), F.lit(1.0)) * 100).alias("Accuracy"),
        F.bround(ape * 100, 2).alias("APE"),
    )


def complete_list(forecast: DataFrame, items: DataFrame, units: float = 2, stock: float = 5) -> DataFrame:
    """Append every master item without a forecast at a defensive floor.

    ``forecast`` is (item, Last_Month_Actual, Future_Forecast, Safe_Stock_Level).
    """
    missing = items.select(ITEM).distinct().join(forecast.select(ITEM), ITEM, "left_anti")
    return forecast.unionByName(
        missing.select(
            ITEM,
            F.lit(0).cast(forecast.schema["Last_Month_Actual"].dataType).alias("Last_Month_Actual"),
            F.lit(units).cast(forecast.schema["Future_Forecast"].dataType).alias("Future_Forecast"),
            F.lit(stock).cast(forecast.schema["Safe_Stock_Level"].dataType).alias("Safe_Stock_Level"),
        )
    )


def inventory_status(df: DataFrame, heavy: float = 200) -> DataFrame:
    """Risk when the forecast exceeds last month; heavy when the stock level is high."""
    return df.withColumn(
        "Stock_Status",
        F.when(F.col("Future_Forecast") > F.col("Last_Month_Actual"), "Risk")
        .when(F.col("Safe_Stock_Level") > heavy, "Heavy")
        .otherwise("OK"),
    )


def volume_status(df: DataFrame, column: str = "Safe_Stock_Level", high: float = 100, medium: float = 60) -> DataFrame:
    return df.withColumn(
        "Volume_Status",
        F.when(F.col(column) > high, "High").when(F.col(column) > medium, "Moderate").otherwise("Normal"),
    )


def _growth(now: Column, before: Column) -> Column:
    return ratio(now - before, zero_as_one(before)) * 100


def month_over_month(df: DataFrame, band: float = 5) -> DataFrame:
    """Forecast against last month with an Increase / Decrease / Stagnant trend."""
    pct = _growth(F.col("Future_Forecast"), F.col("Last_Month_Actual"))
    return df.withColumn("mom_growth_pct", pct).withColumn(
        "Trend",
        F.when(F.col("mom_growth_pct") > band, "Increase")
        .when(F.col("mom_growth_pct") < -band, "Decrease")
        .otherwise("Stagnant"),
    )


def year_over_year(forecast: DataFrame, history: DataFrame, start: str, end: str, value: str = "Future_Forecast") -> DataFrame:
    """Forecast against the same month of an earlier year (no sales then counts as 1)."""
    base = (
        history.filter(F.col(DAY).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy(ITEM)
        .agg(F.sum(QTY).alias("base_units"))
    )
    df = forecast.join(base, ITEM, "left").withColumn("base_units", F.coalesce("base_units", F.lit(0)))
    pct = _growth(F.col(value), F.col("base_units"))
    return df.withColumn("yoy_growth_pct", pct).withColumn(
        "Status",
        F.when(F.col("yoy_growth_pct") > 5, "Booming")
        .when(F.col("yoy_growth_pct") >= 1, "Growing")
        .when(F.col("yoy_growth_pct") >= -1, "Flat")
        .otherwise("Declining"),
    )


def lifetime_growth(history: DataFrame, day: str = DAY, value: str = QTY) -> DataFrame:
    """Units of the first and the last observed month and the growth between them."""
    months = history.groupBy(dates.month_start(F.col(day)).alias("month")).agg(F.sum(value).alias("units"))
    ends = months.agg(
        F.min_by("units", "month").alias("first_month_units"),
        F.max_by("units", "month").alias("last_month_units"),
    )
    return ends.withColumn(
        "lifetime_growth_pct",
        F.when(
            F.col("first_month_units") > 0,
            ratio(F.col("last_month_units") - F.col("first_month_units"), F.col("first_month_units")) * 100,
        ).otherwise(F.lit(0.0)),
    )


def growth_summary(forecast_total: DataFrame, history: DataFrame, base_month: str, recent_month: str) -> DataFrame:
    """Total forecast against two historical months (each given by any of its dates)."""
    total = forecast_total.select(F.col("total")).scalar()

    def units(month: str) -> Column:
        return F.coalesce(
            F.sum(
                F.when(
                    dates.month_start(F.col(DAY)) == F.trunc(F.lit(month).cast("date"), "month"), F.col(QTY)
                )
            ),
            F.lit(0),
        )

    sums = history.agg(units(base_month).alias("base_units"), units(recent_month).alias("recent_units"))

    def growth(col: str) -> Column:
        return F.when(F.col(col) > 0, ratio(F.col("forecast_units") - F.col(col), F.col(col)) * 100).otherwise(
            F.lit(0.0)
        )

    return sums.withColumn("forecast_units", total).select(
        "forecast_units", "base_units", "recent_units", growth("base_units").alias("growth_vs_base"),
        growth("recent_units").alias("momentum"),
    )


def next_month_projection(df: DataFrame, rmse: float | Column, growth: float = 1.04, z: float = 1.65) -> DataFrame:
    """Scale last predictions by a growth factor and add an error buffer."""
    rmse = rmse if isinstance(rmse, Column) else F.lit(float(rmse))
    ahead = F.col("Predicted_Sales") * growth
    return df.withColumn("Next_Forecast", F.bround(ahead, 1)).withColumn(
        "Safe_Stock_Level", F.bround(ahead + F.lit(z) * rmse, 0).cast("long")
    )


def tiered_stock(df: DataFrame, rmse: dict[str, float | Column], z: float = 1.65, floor: float = 5) -> DataFrame:
    """Safety stock by method: prediction plus that method's error, else a floor."""
    level = F.when(F.lit(False), F.lit(0.0))
    for method, error in rmse.items():
        error = error if isinstance(error, Column) else F.lit(float(error))
        level = level.when(F.col("Model") == method, F.col("Predicted") + F.lit(z) * error)
    return df.withColumn("Safe_Stock", F.bround(level.otherwise(F.lit(float(floor))), 0).cast("long"))


def against_last_year(forecast: DataFrame, history: DataFrame, item: str = ITEM) -> DataFrame:
    """Monthly forecast next to the same month's actuals one year earlier (none reads 0)."""
    actual = history.groupBy(item, dates.month_start(F.col(DAY)).alias("_m")).agg(F.sum(QTY).alias("last_year_units"))
    ahead = forecast.groupBy(item, dates.month_start(F.col("date")).alias("month")).agg(F.sum("qty").alias("forecast_units"))
    return (
        ahead.withColumn("_m", F.add_months("month", -12))
        .join(actual, [item, "_m"], "left")
        .select(item, "month", "forecast_units", F.coalesce("last_year_units", F.lit(0)).alias("last_year_units"))
    )
