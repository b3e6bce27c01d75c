"""Channel carry-over, return on investment and budget allocation.

Weekly spend is held in long form (date, channel, spend); a market column can be
added through ``keys`` to run many markets at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.functions.numeric import ratio
from tillwise.operators.regress import least_squares, named_coefficients

# Carry-over rates and ROI figures of the published analysis.
CARRY_OVER = {"tv_s": 0.7, "ooh_s": 0.5, "print_s": 0.6, "facebook_s": 0.3, "search_s": 0.2}
CHANNELS = ("tv_s", "ooh_s", "print_s", "facebook_s", "search_s")
PUBLISHED_ROI = {"facebook_s": 1.77, "tv_s": 0.90, "ooh_s": 0.54, "print_s": 0.21, "search_s": 0.04}


def to_long(weekly: DataFrame, channels: Sequence[str] = CHANNELS, keep: Sequence[str] = ("date",)) -> DataFrame:
    """Wide weekly table to (date, channel, spend)."""
    return weekly.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("spend")) for c in channels])
        ).alias("c"),
    ).select(*keep, "c.channel", "c.spend")


# Consecutive weeks of one block of the carry-over recursion.
_ADSTOCK_BLOCK = 256


def _by_channel(channel: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in table.items():
        out = out.when(channel == name, F.lit(float(value)))
    return out if default is None else out.otherwise(F.lit(float(default)))


def dense_weeks(spend: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Fill weeks without spend between the first and last week with 0."""
    span = spend.agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    weeks = spend.select(*keys).distinct().withColumn(
        "date", F.explode(F.sequence(span.getField("a"), span.getField("b"), F.expr("INTERVAL 7 DAYS")))
    )
    return weeks.join(spend, [*keys, "date"], "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))


def adstock(spend: DataFrame, rates: Mapping[str, float], keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Geometric carry-over ``x_t = spend_t + rate * x_(t-1)`` in date order, for any rate; NULL spend counts as 0.

    The recursion is run in two levels: inside blocks of consecutive weeks, and over one row per block whose
    end value decays into the next. Nothing is cut off, and no row gathers more than a block or the list of blocks.
    """
    order = W.partitionBy(*keys).orderBy("date")
    block = [*keys, "_block"]
    rows = spend.withColumn("_rate", _by_channel(F.col("channel"), rates, 0.0)).withColumn("_at", F.row_number().over(order) - 1)
    rows = rows.withColumn("_block", F.floor(F.col("_at") / _ADSTOCK_BLOCK))
    within = W.partitionBy(*block).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_seen", F.collect_list(F.coalesce("spend", F.lit(0.0))).over(within))
    rows = rows.withColumn("_own", F.aggregate("_seen", F.lit(0.0), lambda x, s: x * F.col("_rate") + s)).drop("_seen")
    ends = rows.groupBy(*block).agg(
        F.max_by(F.struct("_own", "_rate"), "_at").alias("_end"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = F.aggregate(
        F.collect_list(F.struct("_end", "_n")).over(earlier),
        F.lit(0.0),
        lambda x, e: x * F.pow(e["_end"]["_rate"], e["_n"]) + e["_end"]["_own"],
    )
    carried = ends.withColumn("_carry", carry).select(*block, "_carry")
    decay = F.pow("_rate", (F.col("_at") % _ADSTOCK_BLOCK + 1).cast("double"))
    return (
        rows.join(carried, block)
        .withColumn("adstock", F.col("_own") + F.col("_carry") * decay)
        .drop("_rate", "_at", "_block", "_own", "_carry")
        .select(*spend.columns, "adstock")
    )


def feature_table(weekly: DataFrame, rates: Mapping[str, float] = CARRY_OVER) -> DataFrame:
    """Wide modelling table: date, profit and one carried-over column per channel."""
    channels = list(rates)
    carried = adstock(to_long(weekly, channels), rates)
    wide = carried.groupBy("date").pivot("channel", channels).agg(F.first("adstock"))
    return weekly.select("date", "profit").join(wide, "date").select("date", "profit", *channel_order(channels))


def channel_order(channels: Sequence[str]) -> list[str]:
    """Known channels in their reporting order, then any others."""
    return [c for c in CHANNELS if c in channels] + [c for c in channels if c not in CHANNELS]


def trend_features(weekly: DataFrame) -> DataFrame:
    """Year, month, day of year and running week number (weekly table, one row a week)."""
    return weekly.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "dayofyear": F.dayofyear("date"),
            "trend": F.row_number().over(W.orderBy("date")) - 1,
        }
    )


def spend_shares(spend: DataFrame) -> DataFrame:
    """Spend per channel, its share and the half-normal prior scale."""
    totals = spend.groupBy("channel").agg(F.sum("spend").alias("spend"))
    everything = W.partitionBy()
    share = ratio(F.col("spend"), F.sum("spend").over(everything))
    scale = 1 / math.sqrt(1 - 2 / math.pi)
    return totals.select(
        "channel", "spend", share.alias("share"),
        (share * F.count(F.lit(1)).over(everything) * F.lit(scale)).alias("prior_sigma"),
    )


def revenue_per_spend(spend: DataFrame, results: DataFrame, value: str = "profit") -> DataFrame:
    total = spend.agg(F.sum("spend")).scalar()
    return results.agg(F.sum(value).alias("revenue")).select(
        "revenue", total.alias("spend"), ratio(F.col("revenue"), total).alias("revenue_per_spend")
    )


def fit_weights(
    table: DataFrame, channels: Sequence[str] = CHANNELS, target: str = "profit", period: int = 12, ridge: float = 0.0
) -> DataFrame:
    """Linear weights with trend and one seasonal pair; (feature, coefficient) rows."""
    names, rows = _design(table, channels, period)
    models = least_squares(rows, [], names, target, [0.0] + [ridge] * (len(names) - 1))
    return named_coefficients(models, [], names)


def _design(table: DataFrame, channels: Sequence[str], period: int) -> tuple[list[str], DataFrame]:
    rows = trend_features(table)
    angle = F.col("trend") * F.lit(2 * math.pi / period)
    rows = rows.withColumns(
        {"one": F.lit(1.0), "trend": F.col("trend").cast("double"), "season_sin": F.sin(angle), "season_cos": F.cos(angle)}
    )
    return ["one", "trend", "season_sin", "season_cos", *channels], rows


def predict(table: DataFrame, weights: DataFrame, channels: Sequence[str] = CHANNELS, period: int = 12) -> DataFrame:
    """Fitted values: the few weights enter as one scalar map."""
    names, rows = _design(table, channels, period)
    lookup = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient")))).scalar()
    value = F.lit(0.0)
    for n in names:
        value = value + F.coalesce(F.try_element_at(lookup, F.lit(n)), F.lit(0.0)) * F.col(n)
    return rows.withColumn("pred", value)


def roi_table(carried: DataFrame, weights: DataFrame, use: str = "adstock", keys: Sequence[str] = ()) -> DataFrame:
    """Spend, contribution, weight and ROI per channel (weights joined by name), largest ROI first.

    Rows are ordered by the exact ROI; figures are rounded half-even afterwards.
    """
    sums = carried.groupBy(*keys, "channel").agg(
        F.sum("spend").alias("total_spend"), F.sum(use).alias("_carried")
    )
    joined = sums.join(weights.select("channel", "weight"), "channel")
    contribution = F.col("_carried") * F.col("weight")
    exact = joined.withColumn("_roi", ratio(contribution, F.col("total_spend"))).orderBy(F.desc("_roi"), "channel")
    return exact.select(
        *keys,
        "channel",
        F.bround("total_spend", 2).alias("total_spend"),
        F.bround(contribution, 2).alias("contribution"),
        F.bround("weight", 2).alias("weight"),
        F.bround("_roi", 2).alias("roi"),
    )


def waterfall(carried: DataFrame, weights: DataFrame, predicted_total: Column, order: Sequence[str]) -> DataFrame:
    """Baseline and channel contributions with running bottoms and tops.

    Works on one row per channel after aggregation.
    """
    contrib = (
        carried.groupBy("channel")
        .agg(F.sum("adstock").alias("a"))
        .join(weights.select("channel", "weight"), "channel")
        .select("channel", (F.col("a") * F.col("weight")).alias("value"))
    )
    baseline = contrib.agg(F.sum("value").alias("s")).select(
        F.lit("Baseline (Organic)").alias("channel"), (predicted_total - F.col("s")).alias("value")
    )
    steps = F.array_position(F.array(F.lit("Baseline (Organic)"), *[F.lit(c) for c in order]), F.col("channel"))
    run = W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return (
        baseline.unionByName(contrib)
        .withColumn("position", steps.cast("int"))
        .withColumn("bottom", F.coalesce(F.sum("value").over(run), F.lit(0.0)))
        .withColumn("top", F.col("bottom") + F.col("value"))
    )


def contributions(carried: DataFrame, weights: DataFrame, use: str = "spend") -> DataFrame:
    """Contribution per date and channel."""
    return carried.join(weights.select("channel", "weight"), "channel").select(
        "date", "channel", "spend", (F.col(use) * F.col("weight")).alias("contribution")
    )


def roas(contribution: DataFrame) -> DataFrame:
    return contribution.groupBy("channel").agg(
        ratio(F.sum("contribution"), F.sum("spend")).alias("roas")
    )


def budget_strategies(
    budgets: DataFrame, roi: Mapping[str, float] | DataFrame = PUBLISHED_ROI, switch: float = 15000
) -> DataFrame:
    """Rule-based split: lead channel 55 % (50 % above ``switch``), minor channels 5 %, rest to TV.

    ``budgets`` has one ``budget`` column (other columns are kept).
    """
    b = F.col("budget").cast("double")
    lead = b * F.when(b <= switch, F.lit(0.55)).otherwise(F.lit(0.50))
    minor = b * 0.05
    split = {
        "facebook_s": lead, "tv_s": b - lead - minor * 3, "ooh_s": minor, "print_s": minor, "search_s": minor,
    }
    rows = budgets.withColumn(
        "_s",
        F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("allocation")) for c, v in split.items()])),
    ).select(*budgets.columns, "_s.channel", "_s.allocation")
    if isinstance(roi, DataFrame):
        rows = rows.join(roi.select("channel", "roi"), "channel")
    else:
        rows = rows.withColumn("roi", _by_channel(F.col("channel"), roi))
    return rows.withColumn("expected_profit", F.col("allocation") * F.col("roi"))


def best_allocation(
    scenarios: DataFrame, keys: Sequence[str], low: float = 0.05, high: float = 0.50
) -> DataFrame:
    """Best split of each budget for linear returns with per-channel bounds.

    Every channel starts at ``low`` of the budget; what is left goes to channels
    in order of weight, each up to ``high``. ``scenarios`` has one row per
    (keys, channel) with ``budget`` and ``weight``. Where the bounds leave no split that
    spends the whole budget, ``feasible`` is false and allocation and contribution are NULL.
    """
    number = F.count(F.lit(1)).over(W.partitionBy(*keys))
    feasible = (number * low <= 1) & (number * high >= 1)
    order = W.partitionBy(*keys).orderBy(F.desc("weight"), F.asc("channel"))
    room = F.col("budget") * (high - low)
    spare = F.col("budget") - F.col("budget") * low * F.count(F.lit(1)).over(W.partitionBy(*keys))
    taken_before = room * (F.row_number().over(order) - 1)
    extra = F.least(F.greatest(spare - taken_before, F.lit(0.0)), room)
    return (
        scenarios.withColumn("feasible", feasible)
        .withColumn("allocation", F.when(F.col("feasible"), F.col("budget") * low + extra))
        .withColumn("contribution", F.col("allocation") * F.col("weight"))
    )


def response_curves(spend: DataFrame, weights: DataFrame, form: str = "linear", reach: float = 1.5, points: int = 100) -> DataFrame:
    """Response per channel on an even grid from 0 to ``reach`` times the largest spend.

    ``linear``: weight*s; ``log``: weight*1000*log(1+s); ``saturating``:
    weight*1200*log(1+s/100).
    """
    top = spend.groupBy("channel").agg((F.max("spend") * reach).alias("_top"))
    grid = (
        top.join(weights.select("channel", "weight"), "channel")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("grid_spend", F.col("_top") * F.col("point") / F.lit(float(points - 1)))
    )
    s, w = F.col("grid_spend"), F.col("weight")
    response = {
        "linear": w * s,
        "log": F.log1p(s) * (w * 1000),
        "saturating": (w * 1200) * F.log1p(s / 100),
    }[form]
    return grid.select("channel", "point", "grid_spend", response.alias("response"))
