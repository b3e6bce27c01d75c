"""Customer value: purchase history summaries, lifetime models and segments."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tillwise.functions.numeric import ratio
from tillwise.operators.impute import fit_imputation
from tillwise.operators.lifetime import (  # noqa: F401  part of this module's interface
    FrequencyModel, SpendModel, fit_frequency_model, fit_spend_model, model_table,
)
from tillwise.operators.ordering import medians
from tillwise.session import staged

ID = "CustomerKey"


# --- purchase history ------------------------------------------------------

def transactions(sales: DataFrame, products: DataFrame) -> DataFrame:
    """(OrderDate, CustomerKey, Profit) per sale line; unknown products drop out."""
    priced = sales.select("OrderDate", ID, "OrderQuantity", "ProductKey").join(
        products.select("ProductKey", "ProductCost", "ProductPrice"), "ProductKey", "left"
    )
    profit = (F.col("ProductPrice") - F.col("ProductCost")) * F.col("OrderQuantity")
    return priced.select("OrderDate", ID, profit.alias("Profit")).na.drop()


def purchase_summary(history: DataFrame, end: Column | None = None) -> DataFrame:
    """frequency, recency, T and mean repeat value per customer (day grain).

    Lines are first added up per customer and day, so a customer with a huge
    number of lines contributes one row per active day.
    """
    days = history.groupBy(ID, "OrderDate").agg(F.sum("Profit").alias("z"))
    if end is None:
        # The last day and the customers both read the days, so the lines behind them are joined once.
        days = staged(days, "days")
    last = end if end is not None else days.agg(F.max("OrderDate")).scalar()
    per = days.groupBy(ID).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("OrderDate").alias("first"),
        F.max("OrderDate").alias("latest"),
        F.sum("z").alias("all_z"),
        F.min_by("z", "OrderDate").alias("first_z"),
    )
    repeats = F.col("days") - 1
    return per.select(
        ID,
        repeats.alias("frequency"),
        F.datediff("latest", "first").alias("recency"),
        F.datediff(last, F.col("first")).alias("T"),
        F.when(repeats > 0, (F.col("all_z") - F.col("first_z")) / repeats).otherwise(F.lit(0.0)).alias("monetary_value"),
    )


def calibration_summary(history: DataFrame, cut: str, end: str) -> DataFrame:
    """Summary up to ``cut`` next to purchases between ``cut`` and ``end``.

    Only customers already active before ``cut`` appear.
    """
    cut_day, end_day = F.lit(cut).cast("date"), F.lit(end).cast("date")
    cal = purchase_summary(history.filter(F.col("OrderDate") <= cut_day), cut_day)
    held_days = (
        history.filter((F.col("OrderDate") > cut_day) & (F.col("OrderDate") <= end_day))
        .groupBy(ID, "OrderDate")
        .agg(F.sum("Profit").alias("z"), F.count(F.lit(1)).alias("_lines"))
    )
    held = held_days.groupBy(ID).agg(
        F.count(F.lit(1)).alias("frequency_holdout"),
        (F.sum("z") / F.sum("_lines")).alias("monetary_value_holdout"),
    )
    return cal.join(held, ID, "left").select(
        ID,
        F.col("frequency").alias("frequency_cal"),
        F.col("recency").alias("recency_cal"),
        F.col("T").alias("T_cal"),
        F.col("monetary_value").alias("monetary_value_cal"),
        F.coalesce("frequency_holdout", F.lit(0)).alias("frequency_holdout"),
        F.coalesce("monetary_value_holdout", F.lit(0.0)).alias("monetary_value_holdout"),
        F.datediff(end_day, cut_day).alias("duration_holdout"),
    )


def repeat_buyers(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("frequency") > 0)


def with_outlier_flags(summary: DataFrame, many: float = 5, rich: float = 1000) -> DataFrame:
    """Repeat buyers flagged as very frequent and/or very valuable."""
    return repeat_buyers(summary).withColumns(
        {
            "high_freq": F.col("frequency") > many,
            "high_mon": F.coalesce(F.col("monetary_value") > rich, F.lit(False)),
        }
    )


def outlier_groups(summary: DataFrame, many: float = 5, rich: float = 1000) -> dict[str, DataFrame]:
    """core, whales, high_freq and high_mon; flags decide, so nothing is joined back."""
    flagged = with_outlier_flags(summary, many, rich)
    columns = summary.columns
    whale = F.col("high_freq") | F.col("high_mon")
    return {
        "core": flagged.filter(~whale).select(*columns),
        "whales": flagged.filter(whale).select(*columns),
        "high_freq": flagged.filter("high_freq").select(*columns),
        "high_mon": flagged.filter("high_mon").select(*columns),
    }


def outlier_counts(summary: DataFrame, many: float = 5, rich: float = 1000) -> DataFrame:
    """How many customers are in both outlier groups or in just one."""
    f = with_outlier_flags(summary, many, rich)
    return f.agg(
        F.count_if(F.col("high_freq") & F.col("high_mon")).alias("both"),
        F.count_if(~F.col("high_freq") & F.col("high_mon")).alias("only_value"),
        F.count_if(F.col("high_freq") & ~F.col("high_mon")).alias("only_frequency"),
        F.count_if(~F.col("high_freq") & ~F.col("high_mon")).alias("core"),
    )


def outlier_segments(summary: DataFrame, many: float = 5, rich: float = 1000, mode: str = "single") -> DataFrame:
    """Segment numbers of outliers: all 4, or (``split``) 4 value / 5 frequency / 6 both."""
    f = with_outlier_flags(summary, many, rich).filter(F.col("high_freq") | F.col("high_mon"))
    if mode == "single":
        seg = F.lit(4)
    else:
        seg = F.when(F.col("high_freq") & F.col("high_mon"), 6).when(F.col("high_freq"), 5).otherwise(4)
    best = W.partitionBy(ID).orderBy(F.desc("monetary_value"))
    one = f.withColumn("Segment", seg).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
    return one.select(*summary.columns, "Segment")


def purchase_probability(sales: DataFrame, items: DataFrame, top: int = 3) -> DataFrame:
    """Share of a customer's lines per item, the ``top`` items of each customer.

    Lines are counted per customer and product before the item join, so no
    product or customer key carries raw lines through a shuffle. Lines without
    an item count in the total only.
    """
    counted = sales.groupBy(ID, "ProductKey").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(items, "ProductKey", "left").groupBy(ID, "SubcategoryName").agg(F.sum("n").alias("item_count"))
    mine = W.partitionBy(ID)
    total = F.sum("item_count").over(mine)
    known = named.withColumn("total_purchases", total).filter(
        F.col("SubcategoryName").isNotNull() & F.col(ID).isNotNull()
    )
    rank = F.row_number().over(mine.orderBy(F.desc("item_count"), F.asc("SubcategoryName")))
    return known.withColumn("_r", rank).filter(F.col("_r") <= top).select(
        ID, "SubcategoryName", ratio(F.col("item_count"), F.col("total_purchases")).alias("probability")
    )


def demographics(customers: DataFrame, at: str = "2017-08-01") -> DataFrame:
    """Customer attributes with age in whole years (days // 365) at a date."""
    keep = [
        ID, "MaritalStatus", "Gender", "AnnualIncome", "TotalChildren", "EducationLevel", "Occupation", "HomeOwner",
    ]
    age = F.floor(F.datediff(F.lit(at).cast("date"), F.col("BirthDate")) / 365)
    return customers.select(*keep, age.cast("int").alias("Age"))


# --- lifetime models -------------------------------------------------------

def alive_probability(model: FrequencyModel) -> Column:
    """Chance that a customer is still active."""
    x, tx, t = F.col("frequency"), F.col("recency"), F.col("T")
    odds = (
        F.lit(model.a)
        / (F.lit(model.b) + F.greatest(x, F.lit(1)) - 1)
        * F.pow((t + model.alpha) / (tx + model.alpha), x + model.r)
    )
    return F.when(x == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (odds + 1))


def expected_purchases(model: FrequencyModel, days: float) -> Column:
    """Expected purchases in the next ``days``.

    The hypergeometric term is evaluated in Euler's transformed form by nested multiplication from the
    last term. Terms shrink like z^n times a power of n, so each row takes as many as bring z^n below
    1e-20, half as many again and some for the power: younger customers, with z near 1, take more.
    """
    x, tx, t = F.col("frequency"), F.col("recency"), F.col("T")
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    z = F.lit(float(days)) / (t + (alpha + days))
    below = x + (a + b - 1)
    terms = F.coalesce(F.ceil(F.lit(1.5 * 20 * math.log(10)) / -F.log(z)), F.lit(0)) + math.ceil(40 + 4 * abs(a))
    series = F.aggregate(
        F.sequence((terms - 1).cast("int"), F.lit(0), F.lit(-1)),
        F.lit(1.0),
        lambda acc, n: F.lit(1.0) + acc * z * (n + (a + b - 1 - r)) * (n + (a - 1)) / ((below + n) * (n + 1)),
    )
    survive = F.lit(1.0) - series * F.pow((t + alpha) / (t + (alpha + days)), F.lit(a - 1))
    odds = F.when(x > 0, F.lit(a) / (x + (b - 1)) * F.pow((t + alpha) / (tx + alpha), x + r)).otherwise(F.lit(0.0))
    return below / F.lit(a - 1) * survive / (odds + 1)


def expected_value(model: SpendModel) -> Column:
    """Expected profit per future purchase: own mean shrunk to the population."""
    x, m = F.col("frequency"), F.col("monetary_value")
    own = x * model.p / (x * model.p + (model.q - 1))
    population = F.lit(model.v * model.p / (model.q - 1))
    return (F.lit(1.0) - own) * population + own * m


def score(summary: DataFrame, frequency: FrequencyModel, spend: SpendModel, months: int = 3, discount: float = 0.01) -> DataFrame:
    """Activity, purchases, value and discounted 90-day worth per customer."""
    steps = [f"_bought_{k}" for k in range(1, months + 1)]
    ahead = summary.withColumns({c: expected_purchases(frequency, 30 * k) for k, c in enumerate(steps, start=1)})
    worth, before = F.lit(0.0), F.lit(0.0)
    for k, c in enumerate(steps, start=1):
        worth = worth + (F.col(c) - before) / F.lit((1 + discount) ** k)
        before = F.col(c)
    return ahead.withColumns(
        {
            "prob_alive": alive_probability(frequency),
            "pred_purchases_90d": before,
            "exp_avg_profit": expected_value(spend),
            "CLV_90d": expected_value(spend) * worth,
        }
    ).drop(*steps)


# --- segments --------------------------------------------------------------

SEGMENT_FEATURES = ("frequency", "recency", "monetary_value")


def fit_segments(summary: DataFrame, k: int = 4, features: Sequence[str] = SEGMENT_FEATURES, restarts: int = 1, seed: int = 42):
    """Standardise and cluster; the cheapest of ``restarts`` seeded runs wins."""
    data = summary.select(*[F.col(c).cast("double").alias(c) for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    for i in range(restarts):
        stages = [
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            KMeans(featuresCol="_scaled", predictionCol="_cluster", k=k, seed=seed + i, maxIter=50),
        ]
        model = Pipeline(stages=stages).fit(data)
        cost = model.stages[-1].summary.trainingCost
        if model.stages[-1].summary.numIter >= 50:
            warnings.warn(f"k-means with {k} clusters did not converge in 50 iterations", stacklevel=2)
        if best is None or cost < best[0]:
            best = (cost, model)
    data.unpersist()
    return best[1]


def assign_segments(summary: DataFrame, model, relabel: bool = True) -> DataFrame:
    """Segment per customer.

    Cluster numbers are arbitrary, so by default they are renamed to carry their
    meaning: 0 least frequent, 2 longest since last purchase among the big
    spenders, 3 frequent with small baskets, 1 the best of the rest.
    """
    out = model.transform(summary).drop("_raw", "_scaled")
    if not relabel:
        return out.withColumnRenamed("_cluster", "Segment")
    centers = model.stages[-1].clusterCenters()
    label = F.when(F.lit(False), 0)
    for old, new in _meaning(np.array(centers)).items():
        label = label.when(F.col("_cluster") == old, new)
    return out.withColumn("Segment", label).drop("_cluster")


def _meaning(centers: np.ndarray) -> dict[int, int]:
    left = list(range(len(centers)))
    if len(left) != 4:
        return {old: new for new, old in enumerate(sorted(left, key=lambda i: tuple(centers[i])))}
    by_frequency = sorted(left, key=lambda i: (centers[i][0], centers[i][1]))
    names = {}
    frequent = by_frequency[2:]
    rare = by_frequency[:2]
    spender = max(rare, key=lambda i: centers[i][2])
    names[spender] = 2
    names[[i for i in rare if i != spender][0]] = 0
    champion = max(frequent, key=lambda i: centers[i][2])
    names[champion] = 1
    names[[i for i in frequent if i != champion][0]] = 3
    return names


def segment_sweep(summary: DataFrame, ks: Sequence[int] = range(2, 11), features: Sequence[str] = SEGMENT_FEATURES) -> DataFrame:
    """Within-cluster cost and silhouette for each number of clusters."""
    data = summary.select(*[F.col(c).cast("double").alias(c) for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    judge = ClusteringEvaluator(featuresCol="_scaled", predictionCol="_cluster")
    rows = []
    for k in ks:
        model = fit_segments(data, k, features)
        rows.append((int(k), float(model.stages[-1].summary.trainingCost), float(judge.evaluate(model.transform(data)))))
    spark = summary.sparkSession
    data.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def combine(core: DataFrame, *outliers: DataFrame) -> DataFrame:
    """Stack core and outliers (missing columns become NULL), first row per customer wins."""
    stacked = core.withColumn("_source", F.lit(0))
    for i, part in enumerate(outliers, start=1):
        stacked = stacked.unionByName(part.withColumn("_source", F.lit(i)), allowMissingColumns=True)
    first = W.partitionBy(ID).orderBy("_source")
    return stacked.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_source")


IMPUTE_COLUMNS = (
    "frequency", "recency", "T", "monetary_value", "prob_alive", "pred_purchases_90d", "exp_avg_profit", "CLV_90d",
)


def impute_chained(df: DataFrame, columns: Sequence[str] = IMPUTE_COLUMNS, rounds: int = 10, tol: float = 1e-3, ridge: float = 1e-6) -> DataFrame:
    """Fill gaps by regressing each incomplete column on the others, in rounds; see ``impute``. Observed cells never change."""
    model = fit_imputation(df, columns, rounds, tol, ridge)
    if not model.converged:
        warnings.warn(f"imputation still changed by {model.change:g} after {model.rounds} rounds", stacklevel=2)
    return model.apply(df)


def financial_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("CLV_at_Risk", F.col("CLV_90d") * 0.10).withColumn(
        "Marketing_Budget_90d", F.col("CLV_90d") * 0.20
    )


def risk_by_segment(df: DataFrame, key: str = "Segment") -> DataFrame:
    return df.groupBy(key).agg(F.sum("CLV_90d").alias("CLV_90d"), F.sum("CLV_at_Risk").alias("CLV_at_Risk"))


# Segment names, reasons, strategies and plans of the strategy table.
SEGMENT_STRATEGIES = [
    (4, "High-Value Whales",
     "Heuristic: Extreme Monetary outliers. High-ticket, high-equity clients.",
     "VIP Treatment: Retention of high-equity assets.",
     "Provide white-glove service and dedicated VIP support. No model needed; value is inherently maximum."),
    (5, "Operational Whales",
     "Heuristic: Extreme Frequency outliers. High-volume, habitual buyers.",
     "Cross-Sell/Education: Increasing category depth.",
     "Send targeted emails to educate on business-grade items. Offer discounts on complementary items they are not yet buying."),
    (1, "Elite Champions",
     "Core Model: High Frequency & High Recency. Most active core customers.",
     "Loyalty Protection: Maintain high engagement.",
     "Permanent loyalty status and early access to new product launches."),
    (3, "Loyal Daily-Drivers",
     "Core Model: High Frequency / Low Monetary Value. Frequent small-basket buyers.",
     "Margin Optimization: Increase basket size.",
     "Bundle low-margin items with high-margin accessories to optimize profit per order."),
    (2, "Slipping High-Spenders",
     "Core Model: High Historical Spend / Low Recency. At-risk premium customers.",
     "Win-Back: Urgent re-activation.",
     'High-incentive "We Miss You" offers tailored to their historically preferred luxury categories.'),
    (0, "Potential Growth",
     "Core Model: Low Frequency. Recent first-time buyers.",
     "Conversion: Secure the 2nd purchase habit.",
     "Welcome sequence focused on brand story and a 2nd-purchase discount trigger."),
]


def strategy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SEGMENT_STRATEGIES, "Segment int, segment_name string, reason string, strategy string, plan string"
    )


def with_strategies(df: DataFrame) -> DataFrame:
    """Attach the six-row strategy table (a fixed size, hence broadcast)."""
    return df.join(F.broadcast(strategy_table(df.sparkSession)), "Segment", "left")


def segment_counts(df: DataFrame, features: Sequence[str] = SEGMENT_FEATURES) -> DataFrame:
    return df.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("customers"), *[F.avg(c).alias(f"mean_{c}") for c in features]
    )


def segment_profile(
    df: DataFrame,
    numeric: Sequence[str],
    shares: Mapping[str, Column],
    categorical: Sequence[str],
    key: str = "Segment",
) -> DataFrame:
    """Per segment: exact medians, shares of yes-rows and the most common categories."""
    mid = medians(df, {c: c for c in numeric}, [key])
    rest = df.groupBy(key).agg(
        *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in shares.items()],
        *[F.mode(c, True).alias(c) for c in categorical],
    )
    return mid.join(rest, key)


# Rough multipliers of the core median used for outlier segments.
OVERRIDES = {
    4: {"prob_alive": 0.95, "pred_purchases_90d": 1.2, "exp_avg_profit": 2.0, "CLV_90d": 1.8},
    5: {"prob_alive": 0.98, "pred_purchases_90d": 2.5, "exp_avg_profit": 1.1, "CLV_90d": 1.5},
}


def override_outliers(profile: DataFrame, overrides: Mapping[int, Mapping[str, float]] = OVERRIDES, digits: int = 3) -> DataFrame:
    """Replace modelled medians of outlier segments by multiples of the core baseline.

    The baseline is the median over the handful of core segments.
    """
    columns = ["prob_alive", "pred_purchases_90d", "exp_avg_profit", "CLV_90d"]
    base = profile.filter(F.col("Segment") < 4).agg(F.struct(*[F.median(c).alias(c) for c in columns])).scalar()
    out = profile
    for c in columns:
        value = F.col(c)
        for segment, factors in overrides.items():
            new = F.lit(factors[c]) if c == "prob_alive" else base.getField(c) * factors[c]
            value = F.when(F.col("Segment") == segment, new).otherwise(value)
        out = out.withColumn(c, F.bround(value, digits))
    return out


def worth_by_persona(df: DataFrame, rows: str, columns: str, levels: Sequence[str], value: str = "CLV_90d") -> DataFrame:
    """Mean value by two attributes as a matrix."""
    return df.groupBy(rows).pivot(columns, list(levels)).agg(F.avg(value))
