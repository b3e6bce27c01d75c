"""Price response by category and promotion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.functions.numeric import ratio
from tillwise.operators.ordering import medians, quantiles
from tillwise.session import staged

ITEM = "CategoryName"
BASE_EVENT = "No Promo"


def unit_cost() -> Column:
    return F.col("ProductPrice") - ratio(F.col("profit"), F.col("OrderQuantity"))


def baseline(df: DataFrame) -> DataFrame:
    """Median price, quantity and profit of each category without promotion."""
    return medians(
        df.filter(F.col("event") == BASE_EVENT),
        {"orig_price": "ProductPrice", "orig_qty": "OrderQuantity", "orig_profit": "profit"},
        [ITEM],
    )


def event_prices(df: DataFrame) -> DataFrame:
    return medians(df, {"adjusted_price": "ProductPrice"}, [ITEM, "event"])


def unit_costs(df: DataFrame) -> DataFrame:
    return medians(df, {"unit_cost": unit_cost()}, [ITEM])


# --- promotion model -------------------------------------------------------

def promo_guard(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Categories that can be modelled: enough rows and more than one price."""
    stats = df.groupBy(ITEM).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ProductPrice").alias("lo"), F.max("ProductPrice").alias("hi")
    )
    return stats.filter((F.col("rows") >= min_rows) & (F.col("lo") < F.col("hi"))).select(ITEM, "rows")


def fit_promo(df: DataFrame, ridge: float = 0.6, min_rows: int = 5) -> DataFrame:
    """quantity ~ price + event per category.

    Sums per (category, event) are sufficient, so a category reaches the solver
    as one row per event. The price slope and event effects are shrunk by
    ``ridge``; the intercept is not. Result: (category, event, intercept, slope).
    """
    usable = df.na.drop(subset=["ProductPrice", "OrderQuantity", "event"])
    p, q = F.col("ProductPrice").cast("double"), F.col("OrderQuantity").cast("double")
    sums = (
        usable.groupBy(ITEM, "event")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("p"), F.sum(p * p).alias("pp"),
            F.sum(p * q).alias("pq"), F.sum(q).alias("q"),
        )
        .join(promo_guard(usable, min_rows), ITEM, "left_semi")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event")
        k = len(pdf) + 2
        a, b = np.zeros((k, k)), np.zeros(k)
        n, p1 = pdf["n"].to_numpy(), pdf["p"].to_numpy()
        a[0, 0], a[0, 1], a[1, 1] = n.sum(), p1.sum(), pdf["pp"].sum()
        a[0, 2:], a[1, 2:] = n, p1
        a[2:, 2:] = np.diag(n)
        a = a + np.triu(a, 1).T
        b[0], b[1], b[2:] = pdf["q"].sum(), pdf["pq"].sum(), pdf["q"]
        a[np.arange(1, k), np.arange(1, k)] += ridge
        scale = np.sqrt(np.diag(a))
        beta = (np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (b / scale)) / scale
        return pd.DataFrame(
            {ITEM: pdf[ITEM], "event": pdf["event"], "intercept": beta[0] + beta[2:], "slope": beta[1]}
        )

    return sums.groupBy(ITEM).applyInPandas(fit, f"{ITEM} string, event string, intercept double, slope double")


def price_medians(df: DataFrame) -> DataFrame:
    """Per category and event: adjusted_price, and the category's unit_cost, orig_price, orig_qty and orig_profit.

    All medians are selected together, so the facts are read twice however many there are.
    """
    def entry(name: str, value: Column, per_event: bool = False, when: Column | None = None) -> Column:
        value = value.cast("double") if when is None else F.when(when, value.cast("double"))
        event = F.col("event") if per_event else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("m"), event.alias("e"), value.alias("v"))

    plain = F.col("event") == BASE_EVENT
    base = {"orig_price": "ProductPrice", "orig_qty": "OrderQuantity", "orig_profit": "profit"}
    entries = [entry("adjusted_price", F.col("ProductPrice"), True, F.col("event").isNotNull()), entry("unit_cost", unit_cost())]
    entries += [entry(n, F.col(c), when=plain) for n, c in base.items()]
    long = quantiles(df.select(ITEM, F.inline(F.array(*entries))), "v", [0.5], [ITEM, "m", "e"], ["q"])
    whole = [F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n in ("unit_cost", *base)]
    by_event = F.collect_list(F.when(F.col("m") == "adjusted_price", F.struct(F.col("e").alias("event"), F.col("q").alias("adjusted_price"))))
    return long.groupBy(ITEM).agg(*whole, by_event.alias("events")).select(ITEM, "unit_cost", *base, F.inline("events"))


def performance_table(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected quantity, revenue and profit per category and event next to the baseline.

    ``expected`` is (category, event, intercept, slope). No Promo sorts first.
    """
    q = F.col("intercept") + F.col("slope") * F.col("adjusted_price")
    rows = price_medians(df).filter(F.col("unit_cost").isNotNull()).join(expected, [ITEM, "event"]).withColumn("exp_qty", q)
    return rows.select(
        ITEM, "orig_price", "orig_qty", "orig_profit", "adjusted_price", "exp_qty",
        (F.col("adjusted_price") * F.col("exp_qty")).alias("exp_revenue"),
        ((F.col("adjusted_price") - F.col("unit_cost")) * F.col("exp_qty")).alias("exp_profit"),
        "event",
    ).orderBy(ITEM, F.col("event") != BASE_EVENT, "event")


# --- demand curve ----------------------------------------------------------

def _cubic_weights(t: Column) -> list[Column]:
    """The four uniform cubic spline weights at local position t in [0, 1]."""
    s = F.lit(1.0) - t
    return [
        s * s * s / 6,
        (t * t * t * 3 - t * t * 6 + 4) / 6,
        (t * t * t * -3 + t * t * 3 + t * 3 + 1) / 6,
        t * t * t / 6,
    ]


def _place(price: Column, lo: Column, hi: Column, pieces: int) -> tuple[Column, Column]:
    """Spline piece and local position of a price; outside prices extend the end pieces."""
    u = F.coalesce(F.try_divide(price - lo, hi - lo), F.lit(0.0)) * pieces
    piece = F.least(F.greatest(F.floor(u), F.lit(0)), F.lit(pieces - 1)).cast("int")
    return piece, u - piece


LEVELS = (0.025, 0.5, 0.975)


def _smoothing(splines: int, penalty: float) -> np.ndarray:
    difference = np.diff(np.eye(splines), n=2, axis=0)
    return penalty * difference.T @ difference + 1e-9 * np.eye(splines)


def _placed(df: DataFrame, splines: int, event: str | None) -> DataFrame:
    """Equal (category, price, quantity) rows merged, with their spline piece ``m``, basis weights, lo and hi.

    The categories' price bounds come as one map: facts are neither joined nor shuffled on their few categories.
    """
    rows = df if event is None else df.filter(F.col("event") == event)
    rows = rows.select(
        ITEM, F.col("ProductPrice").cast("double").alias("p"), F.col("OrderQuantity").cast("double").alias("q")
    ).na.drop()
    merged = staged(rows.groupBy(ITEM, "p", "q").agg(F.count(F.lit(1)).cast("double").alias("c")), "merged")
    ends = merged.groupBy(ITEM).agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi")).alias("ends"))
    bounds = ends.agg(F.map_from_entries(F.collect_list(F.struct(ITEM, "ends")))).scalar()
    placed = merged.withColumn("ends", F.try_element_at(bounds, F.col(ITEM))).select(ITEM, "p", "q", "c", "ends.lo", "ends.hi")
    piece, t = _place(F.col("p"), F.col("lo"), F.col("hi"), splines - 3)
    placed = placed.withColumn("m", piece).withColumn("t", t)
    return placed.withColumns({f"w{i}": w for i, w in enumerate(_cubic_weights(F.col("t")))})


def _weighted(placed: DataFrame, curves: DataFrame) -> DataFrame:
    """Each row once per level, with the level's fit and its weight on the side of the fit it lies on."""
    state = curves.groupBy(ITEM).agg(F.collect_list(F.struct("level", "coefficients")).alias("levels"))
    by_item = state.agg(F.map_from_entries(F.collect_list(F.struct(ITEM, "levels")))).scalar()
    rows = placed.withColumn("levels", F.try_element_at(by_item, F.col(ITEM))).select(*placed.columns, F.inline("levels"))
    fitted = F.lit(0.0)
    for i in range(4):
        fitted = fitted + F.get("coefficients", F.col("m") + i) * F.col(f"w{i}")
    side = F.when(F.col("q") > F.col("fitted"), F.col("level")).otherwise(1 - F.col("level")) * 2
    return rows.withColumn("fitted", fitted).withColumn("weight", F.col("c") * side)


def fit_expectile_curves(
    df: DataFrame, levels: Sequence[float] = LEVELS, splines: int = 20, penalty: float = 0.6, rounds: int = 100,
    tol: float = 1e-9, event: str | None = BASE_EVENT,
) -> DataFrame:
    """Penalised cubic splines of quantity over price: one per category and expectile level.

    Each row touches four neighbouring basis functions, so a category and level is reduced to one row of sums per spline
    piece before it is solved. All levels share one state: a round weighs every row by the side of each level's curve
    it lies on and solves all curves again, until none moves by more than ``tol`` of its size. Result: category, level,
    coefficients, lo, hi, rounds, change (relative, of the last round) and converged.
    """
    placed = staged(_placed(df, splines, event), "placed")
    smooth = _smoothing(splines, penalty)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((splines, splines)), np.zeros(splines)
        for row in pdf.itertuples(index=False):
            m = int(row.m)
            block = np.zeros((4, 4))
            block[np.triu_indices(4)] = row.xx
            a[m : m + 4, m : m + 4] += block + np.triu(block, 1).T
            b[m : m + 4] += row.xy
        beta = np.linalg.lstsq(a + smooth, b, rcond=None)[0]
        return pd.DataFrame({ITEM: [pdf[ITEM].iloc[0]], "level": [pdf["level"].iloc[0]], "coefficients": [beta.tolist()], "lo": [pdf["lo"].iloc[0]], "hi": [pdf["hi"].iloc[0]]})

    def solve(weighted: DataFrame) -> DataFrame:
        w = [F.col(f"w{i}") for i in range(4)]
        sums = weighted.groupBy(ITEM, "level", "m", "lo", "hi").agg(
            F.array(*[F.sum(F.col("weight") * w[i] * w[j]) for i in range(4) for j in range(i, 4)]).alias("xx"),
            F.array(*[F.sum(F.col("weight") * wi * F.col("q")) for wi in w]).alias("xy"),
        )
        return sums.groupBy(ITEM, "level").applyInPandas(fit, f"{ITEM} string, level double, coefficients array<double>, lo double, hi double")

    start = placed.withColumn("weight", F.col("c")).select("*", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    curves = staged(solve(start), "curves")
    change, done = 0.0, 0
    if any(v != 0.5 for v in levels):
        for done in range(1, rounds + 1):
            now = staged(solve(_weighted(placed, curves)), "curves")
            old = curves.select(ITEM, "level", F.col("coefficients").alias("old"))
            size = F.greatest(F.array_max(F.transform("coefficients", F.abs)), F.lit(1.0))
            moved = F.array_max(F.zip_with("coefficients", "old", lambda x, y: F.abs(x - y))) / size
            change = now.join(old, [ITEM, "level"]).agg(F.max(moved)).first()[0] or 0.0
            curves = now
            if change <= tol:
                break
    return curves.withColumns({"rounds": F.lit(done), "change": F.lit(float(change)), "converged": F.lit(change <= tol)})


def curve_equations(df: DataFrame, curves: DataFrame, splines: int = 20, penalty: float = 0.6, event: str | None = BASE_EVENT) -> DataFrame:
    """category, level, rows and residual: the largest penalised, side-weighted normal equation of the curve, as a share
    of the curve's weighted quantities. Zero if and only if the curve is the expectile."""
    weighted = _weighted(_placed(df, splines, event), curves.select(ITEM, "level", "coefficients"))
    parts = [F.struct((F.col("m") + i).alias("j"), (F.col("weight") * F.col(f"w{i}") * (F.col("q") - F.col("fitted"))).alias("g")) for i in range(4)]
    sums = weighted.select(ITEM, "level", F.inline(F.array(*parts))).groupBy(ITEM, "level", "j").agg(F.sum("g").alias("g"))
    pull = F.aggregate(F.zip_with(F.get(F.lit(_smoothing(splines, penalty).tolist()), F.col("j")), F.col("coefficients"), lambda s, b: s * b), F.lit(0.0), lambda a, x: a + x)
    worst = sums.join(curves.select(ITEM, "level", "coefficients"), [ITEM, "level"]).groupBy(ITEM, "level").agg(F.max(F.abs(F.col("g") - pull)).alias("worst"))
    sizes = weighted.groupBy(ITEM, "level").agg(F.sum("c").cast("long").alias("rows"), F.sum(F.col("weight") * F.abs("q")).alias("size"))
    return worst.join(sizes, [ITEM, "level"]).select(ITEM, "level", "rows", (F.col("worst") / F.greatest("size", F.lit(1.0))).alias("residual"))


def fit_demand_curves(
    df: DataFrame, expectile: float = 0.5, splines: int = 20, penalty: float = 0.6, rounds: int = 100,
    event: str | None = BASE_EVENT,
) -> DataFrame:
    """One level of ``fit_expectile_curves``: category, coefficients, lo, hi."""
    return fit_expectile_curves(df, [expectile], splines, penalty, rounds, event=event).select(ITEM, "coefficients", "lo", "hi")


def demand_at(price: Column, splines: int = 20) -> Column:
    """Quantity of a fitted curve row (coefficients, lo, hi) at a price.

    Beyond the observed prices the end pieces continue as polynomials.
    """
    piece, t = _place(price, F.col("lo"), F.col("hi"), splines - 3)
    total = F.lit(0.0)
    for i, w in enumerate(_cubic_weights(t)):
        total = total + F.get("coefficients", piece + i) * w
    return total


def price_grid(df: DataFrame, points: int = 100, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Even price grid per category from ``low`` x cheapest to ``high`` x dearest."""
    ends = df.groupBy(ITEM).agg(
        (F.min(F.col("ProductPrice").cast("double")) * low).alias("_a"),
        (F.max(F.col("ProductPrice").cast("double")) * high).alias("_z"),
    )
    step = (F.col("_z") - F.col("_a")) / F.lit(float(points - 1))
    return ends.select(
        ITEM, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "_a", step.alias("_step")
    ).select(ITEM, "point", (F.col("_a") + F.col("point") * F.col("_step")).alias("ProductPrice"))


def profit_curve(grid: DataFrame, costs: DataFrame, quantity: Column) -> DataFrame:
    """Simulated profit on the grid with a +-10 % band; ``quantity`` is the demand expression."""
    gain = F.col("ProductPrice") - F.col("unit_cost")
    return grid.withColumn("_q", quantity).join(costs, ITEM).select(
        ITEM,
        "point",
        "ProductPrice",
        (gain * F.col("_q")).alias("profit_mid"),
        (gain * (F.col("_q") * 0.9)).alias("profit_low"),
        (gain * (F.col("_q") * 1.1)).alias("profit_high"),
    )


def best_price(curve: DataFrame, value: str = "profit_mid") -> DataFrame:
    """Grid row with the largest profit per category; the lower price wins ties."""
    best = F.max_by(F.struct("ProductPrice", value), F.struct(F.col(value), -F.col("ProductPrice")))
    return curve.groupBy(ITEM).agg(best.alias("_b")).select(
        ITEM, F.col("_b.ProductPrice").alias("ProductPrice"), F.col(f"_b.{value}").alias(value)
    )


def optimise_prices(df: DataFrame, curves: DataFrame, splines: int = 20) -> DataFrame:
    return profit_curve(price_grid(df).join(curves, ITEM), unit_costs(df), demand_at(F.col("ProductPrice"), splines))


def margin_profit(df: DataFrame, predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predicted quantity times the category's mean unit margin."""
    margin = df.groupBy(ITEM).agg(F.avg(ratio(F.col("profit"), F.col("OrderQuantity"))).alias("unit_margin"))
    out = predictions.join(margin, ITEM)
    return out.withColumns({f"profit_{c}": F.col("unit_margin") * F.col(c) for c in columns})


def event_profit(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Promotion rows with predicted quantity and profit at their own unit cost."""
    pair = lambda: F.concat_ws("\u0000", ITEM, "event")
    # One line per category and event is few: a map keeps the facts from being shuffled to as few keys.
    lines = expected.agg(F.map_from_entries(F.collect_list(F.struct(pair(), F.struct("intercept", "slope"))))).scalar()
    promo = df.filter(F.col("event") != BASE_EVENT).withColumn("_line", F.try_element_at(lines, pair()))
    q = F.col("_line.intercept") + F.col("_line.slope") * F.col("ProductPrice")
    return promo.filter(F.col("_line").isNotNull()).withColumn("unit_cost", unit_cost()).withColumn("pred", q).withColumn(
        "profit_pred", (F.col("ProductPrice") - F.col("unit_cost")) * F.col("pred")
    ).drop("_line")


def category_model(df: DataFrame):
    """One linear model with event and category dummies; returns the fitted pipeline.

    Standard errors, t and p values are on the last stage's training summary.
    """
    stages = [
        StringIndexer(inputCols=["event", ITEM], outputCols=["_e", "_c"], stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=["_e", "_c"], outputCols=["_ev", "_cv"], dropLast=True),
        VectorAssembler(inputCols=["_price", "_ev", "_cv"], outputCol="_features"),
        LinearRegression(featuresCol="_features", labelCol="_y", predictionCol="pred", solver="normal"),
    ]
    rows = df.withColumn("_price", F.col("ProductPrice").cast("double")).withColumn(
        "_y", F.col("OrderQuantity").cast("double")
    )
    return Pipeline(stages=stages).fit(rows)


def category_coefficients(model, spark) -> DataFrame:
    """Named coefficients with standard errors; the first level (alphabetical) is the base."""
    indexer, line = model.stages[0], model.stages[-1]
    names = ["ProductPrice"]
    for prefix, labels in zip(("event", ITEM), indexer.labelsArray):
        names += [f"{prefix}_{label}" for label in labels[:-1]]
    names.append("const")
    values = [*line.coefficients.toArray().tolist(), line.intercept]
    summary = line.summary
    rows = list(zip(names, [float(v) for v in values], [float(e) for e in summary.coefficientStandardErrors]))
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double")
