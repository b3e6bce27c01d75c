"""Sparsity metrics per item and the policies that choose a forecasting method."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.numeric import ratio
from tillwise.operators.ordering import quantiles
from tillwise.operators.panel import DAY, ITEM, QTY


@dataclass(frozen=True)
class Policy:
    """Thresholds on the share of zero days, with optional extra conditions.

    ``dense_limit``: largest zero ratio of the dense route (``dense_open`` makes
    the bound exclusive); ``sparse_limit``: zero ratios beyond it are sparse
    (``sparse_closed`` includes the limit itself).
    """

    dense_limit: float
    sparse_limit: float
    spiky_limit: float | None = None
    dense_open: bool = False
    sparse_closed: bool = False
    velocity_quantile: float | None = None
    velocity_closed: bool = True
    dense: str = "AutoARIMA"
    middle: str = "Prophet"
    sparse: str = "ColdStart"


# Route thresholds of the production and notebook policies.
SALES_POLICY = Policy(0.35, 0.60, spiky_limit=0.50)
RETURNS_POLICY = Policy(0.40, 0.85, spiky_limit=0.70)
RETURNS_NOTEBOOK_POLICY = Policy(0.35, 0.60)
VELOCITY_POLICY = Policy(0.20, 0.60, dense_open=True, sparse_closed=True, velocity_quantile=0.99)
SEQUENCE_POLICY = Policy(
    0.10, 0.50, dense_open=True, sparse_closed=True, velocity_quantile=0.99,
    dense="LSTM", middle="XGBOOST", sparse="COLD_START",
)
SEQUENCE_STRICT_POLICY = Policy(
    0.10, 0.50, dense_open=True, sparse_closed=True, velocity_quantile=0.99,
    velocity_closed=False, dense="LSTM", middle="XGBOOST", sparse="COLD_START",
)
RATIO_ONLY_POLICY = Policy(
    0.10, 0.50, dense_open=True, sparse_closed=True,
    dense="LSTM", middle="XGBOOST", sparse="COLD_START",
)


def metrics(panel: DataFrame, value: str = QTY, day: str = DAY, stock: str | None = "StockDate") -> DataFrame:
    """Totals, zero days, largest day and velocity per item."""
    first = F.min(stock) if stock else F.min(day)
    out = panel.groupBy(ITEM).agg(
        F.sum(value).alias("Total"),
        F.count_if(F.col(value) == 0).alias("ZeroDays"),
        F.count(value).alias("TotalDays"),
        F.max(value).alias("MaxSingleDay"),
        first.alias("FirstDate"),
        F.max(day).alias("LastDate"),
    )
    return out.withColumn("ZeroRatio", ratio(F.col("ZeroDays"), F.col("TotalDays"))).withColumn(
        "DailyVelocity", ratio(F.col("Total"), F.datediff("LastDate", "FirstDate") + 1)
    )


def route(measured: DataFrame, policy: Policy, name: str = "TargetModel") -> DataFrame:
    """Assign each item's method from its metrics."""
    z = F.col("ZeroRatio")
    sparse = (z >= policy.sparse_limit) if policy.sparse_closed else (z > policy.sparse_limit)
    dense = (z < policy.dense_limit) if policy.dense_open else (z <= policy.dense_limit)
    if policy.spiky_limit is not None:
        # An item without any volume has no spike, but every day is zero.
        spiky = F.coalesce(ratio(F.col("MaxSingleDay"), F.col("Total")) > policy.spiky_limit, F.lit(False))
        measured = measured.withColumn("IsSpiky", spiky)
        sparse = F.col("IsSpiky") | sparse | (F.col("Total") == 0)
    choice = F.when(sparse, policy.sparse).when(dense, policy.dense).otherwise(policy.middle)
    if policy.velocity_quantile is not None:
        limit = quantiles(measured, "DailyVelocity", [policy.velocity_quantile]).scalar()
        fast = F.col("DailyVelocity")
        is_fast = (fast >= limit) if policy.velocity_closed else (fast > limit)
        choice = F.when(is_fast, policy.dense).otherwise(choice)
    return measured.withColumn(name, choice)


def route_counts(routed: DataFrame, name: str = "TargetModel") -> DataFrame:
    return routed.groupBy(name).agg(F.count(F.lit(1)).alias("items"))
