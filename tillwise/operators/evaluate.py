"""Forecast accuracy, residual profiles and boosted-tree demand models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window as W, functions as F

from tillwise.functions.numeric import ratio
from tillwise.operators.ordering import medians, with_donors
from tillwise.operators.panel import DAY, ITEM
from tillwise.operators.regress import kernels, moments
from tillwise.session import staged


def error_metrics(scored: DataFrame, keys: Sequence[str] = (), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """RMSE, two sMAPE forms, MAPE and R2 per key.

    ``smape`` uses a tiny epsilon in the denominator, ``smape_safe`` counts a day
    with both values zero as no error; MAPE skips zero actuals.
    """
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    gap, size = F.abs(p - a), F.abs(a) + F.abs(p)
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        (F.avg(F.lit(2.0) * gap / (size + F.lit(1e-10))) * 100).alias("smape"),
        (F.avg(F.coalesce(F.try_divide(F.lit(2.0) * gap, size), F.lit(0.0))) * 100).alias("smape_safe"),
        F.avg(F.try_divide(gap, F.abs(a))).alias("mape"),
        F.sum((a - p) * (a - p)).alias("_sse"),
        F.var_pop(a).alias("_var"),
    )
    return sums.select(
        *keys, "n", "rmse", "smape", "smape_safe", "mape",
        (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"),
    )


def metric_summary(metrics: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, min and max of per-item metrics (one value per item)."""
    long = metrics.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("s"),
    ).select(*keys, "s.metric", "s.v")
    # One value per item and metric, read by every scan of the medians: written once.
    long = staged(long, "metrics")
    by = [*keys, "metric"]
    middle = medians(long, {"median": "v"}, by)
    return long.groupBy(*by).agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).join(
        middle, by, "left"
    ).select(*by, "mean", "median", "min", "max")


def residuals_by_actual(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys, "actual").agg(F.avg(F.col("actual") - F.col("pred")).alias("residual"))


def daily_error(scored: DataFrame, day: str = DAY) -> DataFrame:
    return scored.groupBy(day).agg(F.avg(F.col("actual") - F.col("pred")).alias("mean_error"))


def fit_quality(scored: DataFrame, r2_gate: float = 0.8, mape_gate: float = 0.1) -> DataFrame:
    """R2, MAPE and the accept/revise verdict of a marketing model."""
    m = error_metrics(scored)
    ok = (F.col("r2") > r2_gate) & (F.col("mape") < mape_gate)
    return m.select("n", "r2", "mape", F.when(ok, "EXECUTIVE READY").otherwise("REVISE MODEL").alias("status"))


def _model(features: Sequence[str], target: str, loss: str, params: dict) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    if loss == "poisson":
        regressor = GeneralizedLinearRegression(
            family="poisson", link="log", featuresCol="_features", labelCol=target, predictionCol="pred",
            regParam=params.get("regParam", 0.0), maxIter=params.get("maxIter", 25),
        )
    else:
        regressor = GBTRegressor(
            featuresCol="_features", labelCol=target, predictionCol="pred", seed=42,
            maxIter=params.get("maxIter", 20), maxDepth=params.get("maxDepth", 3),
            stepSize=params.get("stepSize", 0.1), subsamplingRate=params.get("subsamplingRate", 1.0),
        )
    return Pipeline(stages=[assembler, regressor])


def demand_model(train: DataFrame, features: Sequence[str], target: str, loss: str = "squared", **params):
    """Gradient-boosted trees (or a Poisson regression for ``loss='poisson'``)."""
    return _model(features, target, loss, params).fit(train)


def cross_validate(
    blocks: DataFrame,
    features: Sequence[str],
    target: str,
    grid: Sequence[dict],
    loss: str = "squared",
    log_target: bool = True,
) -> DataFrame:
    """Mean RMSE in real units of each parameter set over expanding time folds.

    ``blocks`` carries the block of :func:`tillwise.operators.panel.time_blocks`: fold ``k`` is a filter on it. The loops run
    over a few folds and parameter sets; every fit and score is itself a distributed job. Returns one row per parameter
    set, best first.
    """
    spark = blocks.sparkSession
    blocks = blocks.persist()
    splits = blocks.agg(F.max("block")).first()[0] or 0
    results = []
    for i, params in enumerate(grid):
        total = 0.0
        for k in range(1, splits + 1):
            model = demand_model(blocks.filter(F.col("block") < k), features, target, loss, **params)
            scored = model.transform(blocks.filter(F.col("block") == k))
            real = (lambda c: F.expm1(c)) if log_target else (lambda c: c)
            error = real(F.col(target)) - real(F.col("pred"))
            total += scored.agg(F.sqrt(F.avg(error * error))).first()[0]
        results.append((i, str(sorted(params.items())), total / splits if splits else None))
    blocks.unpersist()
    return spark.createDataFrame(results, "candidate int, params string, rmse double").orderBy("rmse")


def expanding_fits(blocks: DataFrame, features: Sequence[str], target: str, ridges: Sequence[float] = (0.0,)) -> DataFrame:
    """Least squares of every expanding fold and ridge penalty from one scan of the rows.

    ``blocks`` carries the block of :func:`tillwise.operators.panel.time_blocks`. Each block is reduced to its cross products; the
    running sum before a block is what its fold trains on, and the block's own products give the squared error there.
    Returns (fold, ridge, n_train, n_test, coefficients, rmse), a row per fold and penalty; ``features`` must include a
    constant column if wanted, which is penalised like the others. Rows with a NULL feature or target take no part, and
    a fold without training or test rows is left out.
    """
    k, ridges = len(features), [float(r) for r in ridges]
    gram = moments(blocks, ["block"], features, target)
    sums = F.concat("xtx", "xty", F.array("yy", F.col("n").cast("double")))
    long = gram.select("block", F.posexplode(sums).alias("pos", "own"))
    earlier = W.partitionBy("pos").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    cell = F.struct("pos", "before", "own")
    folds = long.withColumn("before", F.sum("own").over(earlier)).filter((F.col("block") > 0) & F.col("before").isNotNull())
    folds = folds.groupBy(F.col("block").alias("fold")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    unpack, answer = kernels()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triangle = k * (k + 1) // 2
        for batch in batches:
            rows = []
            for fold, before, own in batch.itertuples(index=False, name=None):
                (a, b), (test_a, test_b) = ((unpack(v[:triangle], k), np.asarray(v[triangle:-2], float)) for v in (before, own))
                for ridge in ridges:
                    beta = answer(a + ridge * np.eye(k), b)
                    sse = max(float(own[-2] - 2 * beta @ test_b + beta @ test_a @ beta), 0.0)
                    rows.append((fold, ridge, int(before[-1]), int(own[-1]), beta.tolist(), (sse / own[-1]) ** 0.5))
            yield pd.DataFrame(rows, columns=["fold", "ridge", "n_train", "n_test", "coefficients", "rmse"])

    schema = "fold int, ridge double, n_train long, n_test long, coefficients array<double>, rmse double"
    return folds.select("fold", "c.before", "c.own").mapInPandas(run, schema)


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def permutation_importance(
    model,
    data: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str] = (DAY, ITEM),
    log_target: bool = True,
    seed: int = 7,
    repeats: int = 1,
) -> DataFrame:
    """How much RMSE grows, on average over ``repeats``, when one feature's values are permuted across rows.

    All features share one numbering, one permutation per repeat and one join: a row meets its donor, is scored as it is and
    once with each feature taken from the donor. The model scores one table, and one aggregate gives all errors.
    """
    features = list(features)
    real = (lambda c: F.expm1(c)) if log_target else (lambda c: c)
    narrow = data.select(*keys, target, *[f for f in features if f not in keys])
    paired = with_donors(narrow, keys, features, seed, repeats).select(target, "_repeat", F.struct(*features).alias("_own"), "_donor")
    variants = [F.col("_own").withField("_feature", F.lit(""))]
    variants += [F.col("_own").withField(f, F.col("_donor")[f]).withField("_feature", F.lit(f)) for f in features]
    scored = model.transform(paired.select(target, "_repeat", F.inline(F.array(*variants))))
    error = real(F.col(target)) - real(F.col("pred"))
    rmse = scored.groupBy("_feature", "_repeat").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    base = rmse.filter(F.col("_feature") == "").agg(F.avg("rmse")).scalar()
    grown = rmse.filter(F.col("_feature") != "").groupBy(F.col("_feature").alias("feature"))
    return grown.agg((F.avg("rmse") - base).alias("rmse_increase"))
