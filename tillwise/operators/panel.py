"""Dense daily panels (one row per day and item) and their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.functions import dates
from tillwise.operators.encoding import ordinal_codes
from tillwise.operators.ordering import global_index
from tillwise.session import staged

ITEM = "SubcategoryName"
DAY = "OrderDate"
QTY = "OrderQuantity"


def bounds(daily: DataFrame, day: str = DAY, stock: str | None = None) -> Column:
    """First and last day, and the earliest stock date, in one pass over the facts."""
    parts = [F.min(day).alias("first"), F.max(day).alias("last")]
    if stock is not None:
        parts.append(F.min(stock).alias("stock"))
    return daily.agg(F.struct(*parts)).scalar()


def grid(daily: DataFrame, items: DataFrame, day: str = DAY, span: Column | None = None) -> DataFrame:
    """Every day between the first and last observed one, for every item."""
    span = bounds(daily, day) if span is None else span
    days = F.sequence(span.getField("first"), span.getField("last"))
    return items.select(ITEM).distinct().select(F.explode(days).alias(day), ITEM)


def sales_panel(daily: DataFrame, items: DataFrame | None = None, stock_default: Column | None = None) -> DataFrame:
    """Dense sales panel: quantity 0 and the earliest stock date on days without sales.

    ``items=None`` uses the items observed in ``daily`` instead of a master list.
    """
    # The span and the rows both read the daily totals, which cost several shuffles of the facts: they are written once.
    daily = staged(daily.select(DAY, ITEM, QTY, "StockDate"), "daily")
    items = items if items is not None else daily
    span = bounds(daily, DAY, "StockDate")
    default = stock_default if stock_default is not None else span.getField("stock")
    return grid(daily, items, DAY, span).join(daily, [DAY, ITEM], "left").select(
        DAY,
        ITEM,
        F.coalesce(F.col(QTY), F.lit(0)).cast("int").alias(QTY),
        F.coalesce(F.col("StockDate"), default).alias("StockDate"),
    )


def sparse_panel(daily: DataFrame, items: DataFrame, first: str | None = None) -> DataFrame:
    """Observed days only, plus one zero row per master item at the earliest stock date."""
    earliest = daily.agg(F.min("StockDate")).scalar()
    template = items.select(ITEM).distinct().select(
        earliest.alias(DAY), ITEM, F.lit(0).cast("long").alias(QTY), earliest.alias("StockDate")
    )
    rows = daily.select(DAY, ITEM, F.col(QTY).cast("long").alias(QTY), "StockDate").unionByName(template)
    if first is not None:
        rows = rows.filter(F.col(DAY) >= F.lit(first).cast("date"))
    return rows.groupBy(DAY, ITEM).agg(F.sum(QTY).alias(QTY), F.min("StockDate").alias("StockDate"))


def returns_gather(daily_sales: DataFrame, daily_returns: DataFrame, full_outer: bool = False) -> DataFrame:
    """Daily sales with same-day returns of the item.

    The default keeps sale days only, so returns on days without sales are lost,
    as in the original analysis; ``full_outer=True`` keeps them.
    """
    returned = daily_returns.select(
        F.col("ReturnDate"), F.col(ITEM), F.col("ReturnQuantity")
    )
    if full_outer:
        back = returned.withColumn("_day", F.col("ReturnDate"))
        sold = daily_sales.withColumn("_day", F.col(DAY))
        return sold.join(back, ["_day", ITEM], "full").select(
            F.col("_day").alias("ReturnDate"),
            F.coalesce("ReturnQuantity", F.lit(0)).alias("ReturnQuantity"),
            ITEM,
            F.col("_day").alias(DAY),
            F.coalesce(QTY, F.lit(0)).alias(QTY),
        )
    back = returned.withColumnRenamed(ITEM, "_item")
    return daily_sales.join(
        back, (F.col(DAY) == F.col("ReturnDate")) & (F.col(ITEM) == F.col("_item")), "left"
    ).select(
        "ReturnDate",
        F.coalesce("ReturnQuantity", F.lit(0)).alias("ReturnQuantity"),
        ITEM,
        DAY,
        QTY,
    )


def returns_panel(gathered: DataFrame, items: DataFrame) -> DataFrame:
    """Dense returns panel over the range of return dates.

    Sales are carried only on days with a return of the item; the other days
    read 0, as in the original analysis.
    """
    daily = (
        gathered.filter(F.col("ReturnDate").isNotNull() & F.col(ITEM).isNotNull())
        .groupBy("ReturnDate", ITEM)
        .agg(
            F.sum("ReturnQuantity").alias("ReturnQuantity"),
            F.sum(QTY).alias(QTY),
            F.min(DAY).alias(DAY),
        )
    )
    daily = staged(daily, "daily")
    return grid(daily, items, "ReturnDate").join(daily, ["ReturnDate", ITEM], "left").select(
        "ReturnDate",
        ITEM,
        F.coalesce("ReturnQuantity", F.lit(0)).cast("int").alias("ReturnQuantity"),
        F.coalesce(QTY, F.lit(0)).cast("int").alias(QTY),
        F.coalesce(F.col(DAY), F.col("ReturnDate")).alias(DAY),
    )


def split_last_days(df: DataFrame, days: int = 30, day: str = DAY) -> DataFrame:
    """Mark rows ``train`` or ``test`` (the last ``days`` days)."""
    cut = F.date_sub(df.agg(F.max(day)).scalar(), days)
    return df.withColumn("part", F.when(F.col(day) <= cut, "train").otherwise("test"))


def split_by_share(df: DataFrame, share: float = 0.8, day: str = DAY) -> DataFrame:
    """Mark the first ``share`` of rows in date order ``train``, the rest ``test``."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return global_index(df, day, [ITEM]).withColumn(
        "part", F.when(F.col("row_index") < F.floor(n * F.lit(share)), "train").otherwise("test")
    )


def split_last_months(df: DataFrame, months: int = 3, day: str = DAY) -> DataFrame:
    return df.filter(F.col(day) >= F.add_months(df.agg(F.max(day)).scalar(), -months))


def time_blocks(df: DataFrame, splits: int, day: str = DAY) -> DataFrame:
    """Rows in date order cut into ``splits`` equal blocks numbered from 1, after a block 0 that takes the leading rest.

    Expanding fold ``i`` tests on block ``i`` and trains on all before it, so the blocks stand for all folds without a copy of
    a row per fold.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n / F.lit(splits + 1))
    past = F.col("row_index") - (n - size * F.lit(splits))
    block = F.when(past < 0, F.lit(0).cast("long")).otherwise(F.floor(past / size) + 1)
    return global_index(df, day, [ITEM]).withColumn("block", F.coalesce(block, F.lit(0).cast("long")).cast("int"))


def time_folds(df: DataFrame, splits: int, day: str = DAY) -> DataFrame:
    """Expanding-window folds in date order: rows tagged (fold, role), a copy of a row for each fold that uses it."""
    blocks = time_blocks(df, splits, day)
    folds = blocks.withColumn("fold", F.explode(F.sequence(F.greatest("block", F.lit(1)), F.lit(splits))))
    return folds.withColumn("role", F.when(F.col("block") < F.col("fold"), "train").otherwise("test")).drop("block")


def _by_item(day: str = DAY) -> W:
    return W.partitionBy(ITEM).orderBy(day)


def lagged_sales(panel: DataFrame, day: str = "ReturnDate") -> DataFrame:
    """Yesterday's sales of the item; the first day gets the item's mean, truncated."""
    lagged = panel.withColumn("_lag", F.lag(QTY).over(_by_item(day)))
    mean = F.avg("_lag").over(W.partitionBy(ITEM))
    return lagged.withColumn(
        "OrderQuantity_Lag1", F.coalesce("_lag", mean).cast("int")
    ).drop("_lag")


def lags(df: DataFrame, value: str, steps: Sequence[int], day: str = DAY) -> DataFrame:
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(_by_item(day)) for k in steps})


def rolling_means(df: DataFrame, value: str, windows: Sequence[int], day: str = DAY) -> DataFrame:
    """Mean of the preceding ``w`` days (today excluded), NULL until ``w`` days exist."""
    out = {}
    for w in windows:
        frame = _by_item(day).rowsBetween(-w, -1)
        out[f"rolling_mean_{w}"] = F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))
    return df.withColumns(out)


def rolling_median(df: DataFrame, value: str, w: int = 7, day: str = DAY, name: str | None = None) -> DataFrame:
    """Median of the last ``w`` days including today, NULL until ``w`` days exist."""
    frame = _by_item(day).rowsBetween(1 - w, 0)
    held = F.array_sort(F.collect_list(value).over(frame))
    middle = (F.get(held, F.lit((w - 1) // 2)) + F.get(held, F.lit(w // 2))) / 2
    return df.withColumn(name or f"rolling_median_{w}", F.when(F.size(held) == w, middle))


def rolling_std(df: DataFrame, value: str, w: int = 7, day: str = DAY, name: str | None = None) -> DataFrame:
    frame = _by_item(day).rowsBetween(1 - w, 0)
    return df.withColumn(
        name or f"moving_std_{w}",
        F.when(F.count(value).over(frame) == w, F.stddev_samp(value).over(frame)),
    )


def acceleration(df: DataFrame, day: str = DAY) -> DataFrame:
    """Yesterday's value minus yesterday's rolling median of the same item."""
    return df.withColumn(
        "acceleration", F.col("lag_1") - F.lag("rolling_median_7").over(_by_item(day))
    )


def walk_forward_mean(df: DataFrame, value: str, w: int = 15, day: str = DAY, name: str = "ColdStart_Pred") -> DataFrame:
    """Mean of up to ``w`` previous days, 0 on the first day."""
    frame = _by_item(day).rowsBetween(-w, -1)
    return df.withColumn(name, F.coalesce(F.avg(value).over(frame), F.lit(0.0)))


def tail_rows(df: DataFrame, n: int, day: str = DAY) -> DataFrame:
    """The last ``n`` rows of every item, numbered from the newest (1)."""
    newest_first = W.partitionBy(ITEM).orderBy(F.desc(day))
    return df.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= n)


def tail_stats(
    df: DataFrame, value: str, means: Sequence[int] = (7, 14, 15), median: int = 30, day: str = DAY
) -> DataFrame:
    """Per item: means of the last n rows and the median of the last ``median`` rows."""
    recent = tail_rows(df, max([*means, median]), day)
    return recent.groupBy(ITEM).agg(
        *[F.avg(F.when(F.col("_age") <= n, F.col(value))).alias(f"mean_{n}") for n in means],
        F.median(F.when(F.col("_age") <= median, F.col(value))).alias(f"median_{median}"),
    )


def feature_table(panel: DataFrame, log_target: bool = True) -> DataFrame:
    """Model-ready features of the dense panel; missing history reads 0."""
    target = F.log1p(F.col(QTY)) if log_target else F.col(QTY).cast("double")
    df = ordinal_codes(panel, ITEM, "Subcategory_Encoded").withColumn(QTY, target)
    month, yday = F.month(DAY), F.dayofyear(DAY)
    month_sin, month_cos = dates.cyclical(month, 12)
    yday_sin, yday_cos = dates.cyclical(yday, 365)
    df = df.withColumns(
        {
            "month": month,
            "dayofweek": F.weekday(DAY),
            "dayofyear": yday,
            "is_weekend": dates.is_weekend(F.col(DAY)).cast("int"),
            "month_sin": month_sin,
            "month_cos": month_cos,
            "dayofyear_sin": yday_sin,
            "dayofyear_cos": yday_cos,
            "is_holiday": dates.is_us_federal_holiday(F.col(DAY)).cast("int"),
        }
    )
    df = acceleration(rolling_std(rolling_median(lags(df, QTY, [1, 7]), QTY), QTY))
    df = df.withColumn("cat_weekend_inter", F.col("Subcategory_Encoded") * F.col("is_weekend"))
    history = ["lag_1", "lag_7", "rolling_median_7", "moving_std_7", "acceleration"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in history})


def lag_feature_table(daily: DataFrame, steps: Sequence[int] = (1, 2, 3, 7, 14), windows: Sequence[int] = (7, 14)) -> DataFrame:
    """Log target with lags and rolling means; rows without full history are dropped."""
    df = daily.withColumn("target_log", F.log1p(F.col(QTY)))
    df = rolling_means(lags(df, "target_log", steps), "target_log", windows)
    df = df.withColumn("day_of_week", F.weekday(DAY)).withColumn("month", F.month(DAY))
    return df.na.drop()


def sequences(df: DataFrame, features: Sequence[str], target: str, window: int = 7, day: str = DAY) -> DataFrame:
    """Sliding windows of feature rows with the next target, inside each item."""
    frame = _by_item(day).rowsBetween(-window, -1)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)
    return (
        df.withColumn("features", rows)
        .filter(F.size("features") == window)
        .select(ITEM, day, "features", F.col(target).alias("target"))
    )
