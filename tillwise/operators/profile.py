"""Data-quality profiles and descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.functions import dates
from tillwise.functions.numeric import ratio
from tillwise.operators.ordering import global_index, quantiles
from tillwise.session import staged


def schema_report(
    tables: Mapping[str, DataFrame], expected: Mapping[str, int], found: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per table: columns expected, columns found, rows, verdict.

    ``found`` holds the widths of the files themselves (``sources.tables.csv_header``) for tables
    that a reader has already brought to the expected columns.
    """
    report = None
    for name, df in tables.items():
        width = (found or {}).get(name, len(df.columns))
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"),
            F.lit(expected[name]).alias("expected_columns"),
            F.lit(width).alias("found_columns"),
            "rows",
            F.lit(expected[name] == width).alias("matches"),
        )
        report = row if report is None else report.unionByName(row)
    return report


def quality_profile(df: DataFrame) -> DataFrame:
    """Rows, exact duplicates and nulls/distinct values per column.

    Distinct rows are reduced first; nulls per column are then weighted by how
    often each distinct row occurs, so one shuffle serves the whole profile.
    """
    columns = df.columns
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    totals = distinct.agg(
        F.sum("_n").alias("rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"_nulls_{c}")
            for c in columns
        ],
    )
    return totals.select(
        "rows",
        "duplicates",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"_nulls_{c}").alias("nulls"))
                    for c in columns
                ]
            )
        ).alias("c"),
    ).select("c.column_name", "c.nulls", "rows", "duplicates")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def calendar_gaps(df: DataFrame, column: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Expected against actual distinct days between two dates (default: own range)."""
    days = df.select(F.col(column).alias("d")).filter(F.col("d").isNotNull()).distinct()
    agg = days.agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("actual_days")
    )
    first = start if start is not None else F.col("lo")
    last = end if end is not None else F.col("hi")
    return agg.select(
        (F.datediff(last, first) + 1).cast("long").alias("expected_days"),
        "actual_days",
        (F.datediff(last, first) + 1 - F.col("actual_days")).cast("long").alias("missing_days"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column (long form)."""
    stacked = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]
            )
        ).alias("s")
    ).select("s.column_name", "s.v")
    moments = stacked.groupBy("column_name").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quart = quantiles(stacked, "v", [0.25, 0.5, 0.75], ["column_name"], ["q25", "q50", "q75"])
    return moments.join(quart, "column_name")


def orphan_keys(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys used by facts but absent from the dimension, with affected rows.

    Facts are counted per key before the anti join, so a hot key is one row.
    """
    used = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("affected_rows"))
    return used.join(dim.select(key), key, "left_anti")


def missing_from_calendar(facts: DataFrame, calendar: DataFrame, column: str, day: str = "Date") -> DataFrame:
    """Fact rows per date that has no calendar entry."""
    used = facts.groupBy(F.col(column).alias(day)).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(calendar.select(day), day, "left_anti")


def iqr_outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Upper fence ``Q3 + reach * IQR`` and how many values exceed it."""
    quart = quantiles(df, column, [0.25, 0.75], names=["q1", "q3"])
    pair = quart.select(F.struct("q1", "q3")).scalar()
    q1, q3 = pair.getField("q1"), pair.getField("q3")
    fence = q3 + F.lit(reach) * (q3 - q1)
    return df.agg(
        F.max(fence).alias("upper_band"),
        F.count_if(F.col(column) > fence).alias("outliers"),
    )


def daily_total(df: DataFrame, day: str = "OrderDate", value: str = "OrderQuantity") -> DataFrame:
    """Total per day over every day between the first and the last (gaps are 0)."""
    totals = df.groupBy(F.col(day).alias("day")).agg(F.sum(value).alias("units"))
    span = totals.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(totals, "day", "left").select(
        "day", F.coalesce("units", F.lit(0)).alias("units")
    )


def deviation_bands(daily: DataFrame, value: str = "units", high: float = 1.5, low: float = 1.2) -> DataFrame:
    """Flag days above mean + high sigma or below mean - low sigma (sample sigma)."""
    stats = daily.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))).scalar()
    m, s = stats.getField("m"), stats.getField("s")
    return daily.withColumn("critical_high", F.col(value) > m + F.lit(high) * s).withColumn(
        "critical_low", F.col(value) < m - F.lit(low) * s
    )


def monthly(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, dates.month_start(F.col(day)).alias("month")).agg(
        F.sum(value).alias("units")
    )


def last_month_days(daily: DataFrame, day: str = "day") -> DataFrame:
    """Days of the newest month, with weekend and last-seven-days flags."""
    newest = daily.agg(F.max(day)).scalar()
    return (
        daily.filter(dates.month_start(F.col(day)) == dates.month_start(newest))
        .withColumn("is_weekend", dates.is_weekend(F.col(day)))
        .withColumn("in_last_week", F.col(day) > F.date_sub(newest, 7))
    )


def last_week_days(daily: DataFrame, day: str = "day", n: int = 7) -> DataFrame:
    """The last ``n`` days of a dense daily series."""
    newest = daily.agg(F.max(day)).scalar()
    return daily.filter(F.col(day) > F.date_sub(newest, n)).withColumn(
        "is_weekend", dates.is_weekend(F.col(day))
    )


def monthly_matrix(df: DataFrame, top: DataFrame, item: str, day: str, value: str) -> DataFrame:
    """Month x item units for the chosen items, zero where an item did not sell."""
    sold = monthly(df.join(top.select(item), item, "left_semi"), day, value, [item])
    months = sold.select("month").distinct()
    # Both sides hold one row per month or chosen item: attach the item list as an array.
    items = top.agg(F.collect_set(item)).scalar()
    grid = months.select("month", F.explode(items).alias(item))
    return grid.join(sold, ["month", item], "left").select(
        "month", item, F.coalesce("units", F.lit(0)).cast("double").alias("units")
    )


def pct_change(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "change") -> DataFrame:
    """Relative change to the previous row of the same key."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, ratio(F.col(value), before) - 1)


def correlation_matrix(
    matrix: DataFrame, item: str, value: str, key: str = "month", block: int = 256, chunk: int = 4096
) -> DataFrame:
    """Pearson correlation of every pair of items over the ``key`` values both have.

    Values of the same (key, item) are added; rows with a NULL key, item or value take no part, and a pair without spread
    has a NULL correlation. Items are numbered and cut into blocks, keys into chunks. A group of the grid holds two blocks
    and one chunk, at most ``2 * block * chunk`` values, and sums their cross products; sums of the chunks are added. Values
    are centred by item first, which leaves correlations as they are and keeps the sums accurate.
    """
    cells = matrix.select(F.col(key).alias("_key"), F.col(item).alias("_item"), F.col(value).cast("double").alias("v"))
    cells = cells.filter(F.col("_key").isNotNull() & F.col("_item").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    cells = staged(cells.groupBy("_key", "_item").agg(F.sum("v").alias("v")), "cells")
    means = cells.groupBy("_item").agg(F.avg("v").alias("_mean"))
    items = staged(global_index(means, F.pmod(F.xxhash64("_item"), F.lit(1024)), ["_item"], "i"), "items")
    keys = global_index(cells.select("_key").distinct(), F.pmod(F.xxhash64("_key"), F.lit(1024)), ["_key"], "k")
    placed = cells.join(items, "_item").join(keys, "_key").select(
        F.floor(F.col("k") / chunk).alias("chunk"), F.floor(F.col("i") / block).alias("block"), (F.col("k") % chunk).cast("int").alias("k"),
        (F.col("i") % block).cast("int").alias("i"), (F.col("v") - F.col("_mean")).alias("v"),
    )
    last = items.agg(F.floor(F.max("i") / block)).scalar()
    # A cell goes to the groups of its block with every block; the smaller block of a group is p.
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    grid = other.select("chunk", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "k", "i", "v")

    names = ("n", "x", "y", "xx", "yy", "xy")

    def dense(cells: pd.DataFrame, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(cells["i"].max()) + 1
        values, present = np.zeros((len(rows), width)), np.zeros((len(rows), width))
        at = np.searchsorted(rows, cells["k"].to_numpy()), cells["i"].to_numpy()
        values[at], present[at] = cells["v"].to_numpy(), 1.0
        return values, present

    def products(group: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        a, b = (cells[cells["block"] == g] for g in group[1:])
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ("a", "b", *names)})
        rows = np.unique(cells["k"])
        (x, m), (y, o) = dense(a, rows), dense(b, rows)
        sums = {"n": m.T @ o, "x": x.T @ o, "y": m.T @ y, "xx": (x * x).T @ o, "yy": m.T @ (y * y), "xy": x.T @ y}
        i, j = np.nonzero(sums["n"])
        if group[1] == group[2]:
            i, j = i[i <= j], j[i <= j]
        ids = {"a": group[1] * block + i, "b": group[2] * block + j}
        return pd.DataFrame({**ids, **{c: sums[c][i, j] for c in names}})

    parts = grid.groupBy("chunk", "p", "q").applyInPandas(products, "a long, b long, " + ", ".join(f"{c} double" for c in names))
    n, x, y, xx, yy, xy = (F.sum(c) for c in names)
    # Sums of squares that cancel down to rounding are no spread.
    spread_x, spread_y = xx - x * x / n, yy - y * y / n
    real = (spread_x > xx * 1e-12) & (spread_y > yy * 1e-12)
    share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - x * y / n) / F.sqrt(spread_x * spread_y)))
    pairs = parts.groupBy("a", "b").agg(F.when(real, share).alias("correlation"))
    both = pairs.select("correlation", F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    named_a = items.select(F.col("i").alias("a"), F.col("_item").alias("item_a"))
    named_b = items.select(F.col("i").alias("b"), F.col("_item").alias("item_b"))
    return both.join(named_a, "a").join(named_b, "b").select("item_a", "item_b", "correlation")


def autocorrelation(daily: DataFrame, lags: int, day: str = "day", value: str = "units") -> DataFrame:
    """Autocorrelation for lags 0..lags of a dense daily series (equi-join per lag)."""
    mean = daily.agg(F.avg(value)).scalar()
    centred = daily.select(F.col(day).alias("day"), (F.col(value) - mean).alias("z"))
    ahead = centred.select(
        F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), F.col("day"), F.col("z").alias("z0")
    ).withColumn("day", F.date_add("day", F.col("lag")))
    products = ahead.join(centred, "day").groupBy("lag").agg(F.sum(F.col("z0") * F.col("z")).alias("c"))
    c0 = centred.agg(F.sum(F.col("z") * F.col("z"))).scalar()
    return products.select("lag", ratio(F.col("c"), c0).alias("acf"))


def partial_autocorrelation(acf: DataFrame, lags: int) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion over one array of ACF values."""
    packed = acf.filter(F.col("lag") <= lags).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r")
    )

    def step(state: Column, k: Column) -> Column:
        phi, out, r = state["phi"], state["out"], state["r"]
        num = F.element_at(r, k + 1) - F.aggregate(
            F.sequence(F.lit(1), k - 1),
            F.lit(0.0),
            lambda s, j: s + F.coalesce(F.get(phi, j - 1), F.lit(0.0)) * F.element_at(r, k - j + 1),
        )
        den = F.lit(1.0) - F.aggregate(
            F.sequence(F.lit(1), k - 1),
            F.lit(0.0),
            lambda s, j: s + F.coalesce(F.get(phi, j - 1), F.lit(0.0)) * F.element_at(r, j + 1),
        )
        new = F.when(k == 1, F.element_at(r, 2)).otherwise(F.try_divide(num, den))
        kept = F.transform(phi, lambda p, i: p - new * F.get(phi, F.size(phi) - 1 - i))
        return F.struct(
            F.concat(kept, F.array(new)).alias("phi"),
            F.concat(out, F.array(new)).alias("out"),
            r.alias("r"),
        )

    empty = F.array().cast("array<double>")
    walked = packed.select(
        F.aggregate(
            F.sequence(F.lit(1), F.lit(lags)),
            F.struct(empty.alias("phi"), empty.alias("out"), F.col("r").alias("r")),
            step,
        )["out"].alias("pacf")
    )
    return walked.select(F.posexplode("pacf").alias("lag", "pacf")).select(
        (F.col("lag") + 1).alias("lag"), "pacf"
    )


def event_windows(
    daily: DataFrame,
    events: DataFrame,
    day: str = "day",
    value: str = "units",
    around: int = 3,
    before: tuple[int, int] = (10, 4),
) -> DataFrame:
    """Mean and median around, and mean before, each event next to normal days.

    ``events`` holds (event, event_day). Windows are expanded to days, so the
    range condition becomes an equi-join; normal days lie in no window at all.
    """
    near = events.select(
        "event",
        F.lit("event").alias("kind"),
        F.explode(
            F.sequence(F.date_sub("event_day", around), F.date_add("event_day", around))
        ).alias(day),
    )
    prior = events.select(
        "event",
        F.lit("before").alias("kind"),
        F.explode(
            F.sequence(F.date_sub("event_day", before[0]), F.date_sub("event_day", before[1]))
        ).alias(day),
    )
    windows = near.unionByName(prior)
    # One event covers 2*around+1 days: its median is taken over a bounded group.
    hit = (
        windows.join(daily, day)
        .groupBy("event", "kind")
        .agg(F.avg(value).alias("mean_units"), F.median(value).alias("median_units"))
    )
    normal = daily.join(windows.select(day).distinct(), day, "left_anti").agg(
        F.lit("Normal Days").alias("event"),
        F.lit("normal").alias("kind"),
        F.avg(value).alias("mean_units"),
        F.median(value).alias("median_units"),
    )
    return hit.unionByName(normal)


def sparsity(df: DataFrame, value: str) -> DataFrame:
    """Zero and positive records with their share."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) == 0).alias("zero"),
        F.count_if(F.col(value) > 0).alias("positive"),
    )
    return counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("Zero Sales Days").alias("metric"), F.col("zero").alias("records")),
                F.struct(F.lit("Positive Sales Days").alias("metric"), F.col("positive").alias("records")),
            )
        ).alias("s"),
        "n",
    ).select("s.metric", "s.records", (ratio(F.col("s.records"), F.col("n")) * 100).alias("percentage"))
