"""Maximum likelihood fits of customer lifetime models, one aggregate per Newton round.

The log likelihood, its gradient and its Hessian are columns in the distinct (frequency, recency, age) or (frequency, value)
rows with their counts; one aggregate returns their sums at one point, a few numbers whatever the number of customers. The
driver takes the step. A model carries how its fit ended.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.functions.numeric import digamma, lgamma, trigamma
from tillwise.session import staged

Derivatives = tuple[Column, list[Column], Mapping[tuple[int, int], Column]]


@dataclass(frozen=True)
class FrequencyModel:
    """Beta-geometric / NBD purchase process (time unit: days), and how its fit ended."""

    r: float
    alpha: float
    a: float
    b: float
    rounds: int = 0
    gradient: float = 0.0  # largest slope of the penalised mean loss in the logarithms of the parameters
    converged: bool = True


@dataclass(frozen=True)
class SpendModel:
    """Gamma-gamma spend per purchase, and how its fit ended."""

    p: float
    q: float
    v: float
    rounds: int = 0
    gradient: float = 0.0
    converged: bool = True


_ENDING = ("rounds", "gradient", "converged")


def _steps(rows: DataFrame, *steps: Mapping[str, Column]) -> DataFrame:
    """Columns in steps, so that later ones name earlier ones and each is worked out once."""
    return reduce(lambda df, step: df.withColumns(dict(step)), steps, rows)


def frequency_terms(rows: DataFrame) -> tuple[DataFrame, Derivatives]:
    """Log likelihood of rows (x, tx, t) at the point (r, alpha, a, b), with first and second derivatives."""
    x, r, alpha, a, b = (F.col(n) for n in ("x", "r", "alpha", "a", "b"))
    n, alive, gone, last, share = (F.col(f"_{n}") for n in ("n", "alive", "gone", "last", "share"))
    # The customer is alive, or gone since the last purchase; ``share`` is the weight of the second.
    rows = _steps(
        rows,
        {"_n": x + r, "_alive": alpha + F.col("t"), "_gone": alpha + F.col("tx"), "_last": b + F.greatest(x, F.lit(1.0)) - 1, "_both": a + b, "_more": a + b + x},
        {"_log_alive": -n * F.log(alive), "_log_gone": F.log(a) - F.log(last) - n * F.log(gone)},
        {"_top": F.greatest("_log_alive", "_log_gone")},
        {"_mixed": F.col("_top") + F.log(F.exp(F.col("_log_alive") - F.col("_top")) + F.exp(F.col("_log_gone") - F.col("_top")))},
        {"_share": F.when(x > 0, F.exp(F.col("_log_gone") - F.col("_mixed"))).otherwise(F.lit(0.0))},
        {f"_d{name}": digamma(c) for name, c in (("n", n), ("r", r), ("both", F.col("_both")), ("more", F.col("_more")), ("bx", b + x), ("b", b))},
        {f"_t{name}": trigamma(c) for name, c in (("n", n), ("r", r), ("both", F.col("_both")), ("more", F.col("_more")), ("bx", b + x), ("b", b))},
        # Differences of the two branches' slopes, in the order of the parameters.
        {"_a0": F.log(alive) - F.log(gone), "_a1": n / alive - n / gone, "_a2": F.lit(1.0) / a, "_a3": F.lit(-1.0) / last},
    )
    d, t = (lambda k: F.col(f"_d{k}")), (lambda k: F.col(f"_t{k}"))
    rest, apart = 1 - share, [F.col(f"_a{i}") for i in range(4)]
    value = (
        lgamma(n) - lgamma(r) + r * F.log(alpha) + lgamma(F.col("_both")) + lgamma(b + x) - lgamma(b) - lgamma(F.col("_more"))
        + F.when(x > 0, F.col("_mixed")).otherwise(F.col("_log_alive"))
    )
    slope = [
        d("n") - d("r") + F.log(alpha) - F.log(alive) + share * apart[0],
        r / alpha - n / alive + share * apart[1],
        d("both") - d("more") + share * apart[2],
        d("both") + d("bx") - d("b") - d("more") + share * apart[3],
    ]
    pair = t("both") - t("more")
    curve = {
        (0, 0): t("n") - t("r"),
        (0, 1): F.lit(1.0) / alpha - rest / alive - share / gone,
        (1, 1): -r / (alpha * alpha) + rest * n / (alive * alive) + share * n / (gone * gone),
        (2, 2): pair - share / (a * a),
        (2, 3): pair,
        (3, 3): pair + t("bx") - t("b") + share / (last * last),
    }
    for i in range(4):
        for j in range(i, 4):
            curve[i, j] = curve.get((i, j), F.lit(0.0)) + share * rest * apart[i] * apart[j]
    return rows, (value, slope, curve)


def spend_terms(rows: DataFrame) -> tuple[DataFrame, Derivatives]:
    """Log likelihood of rows (x, m) at the point (p, q, v), with first and second derivatives."""
    x, m, p, q, v = (F.col(n) for n in ("x", "m", "p", "q", "v"))
    n, px, whole = F.col("_n"), F.col("_px"), F.col("_whole")
    rows = _steps(
        rows,
        {"_px": p * x, "_n": p * x + q, "_whole": x * m + v},
        {"_dn": digamma(n), "_dp": digamma(px), "_dq": digamma(q), "_tn": trigamma(n), "_tp": trigamma(px), "_tq": trigamma(q), "_log": F.log(whole)},
    )
    d, t = (lambda k: F.col(f"_d{k}")), (lambda k: F.col(f"_t{k}"))
    value = lgamma(n) - lgamma(px) - lgamma(q) + q * F.log(v) + (px - 1) * F.log(m) + px * F.log(x) - n * F.col("_log")
    slope = [
        x * (d("n") - d("p") + F.log(m) + F.log(x) - F.col("_log")),
        d("n") - d("q") + F.log(v) - F.col("_log"),
        q / v - n / whole,
    ]
    curve = {
        (0, 0): x * x * (t("n") - t("p")), (0, 1): x * t("n"), (0, 2): -x / whole,
        (1, 1): t("n") - t("q"), (1, 2): F.lit(1.0) / v - F.lit(1.0) / whole,
        (2, 2): -q / (v * v) + n / (whole * whole),
    }
    return rows, (value, slope, curve)


#: Names of the parameters in order.
POINTS = {frequency_terms: ("r", "alpha", "a", "b"), spend_terms: ("p", "q", "v")}


def penalised(table: DataFrame, terms: Callable[[DataFrame], tuple[DataFrame, Derivatives]], penalty: float) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """The mean loss at a point of log parameters with its gradient and Hessian, from one aggregate over the table."""
    def at(log_point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        point = np.exp(log_point)
        k = len(point)
        w = F.col("weight")
        # The point joins the rows as data: as literals, every round would compile anew.
        struct = ", ".join(f"'{n}', {float(v)!r}D" for n, v in zip(POINTS[terms], point))
        rows = table.select("*", F.inline(F.expr(f"array(named_struct({struct}))")))
        rows, (value, slope, curve) = terms(rows)
        sums = [F.sum(w), F.sum(w * value), *(F.sum(w * s) for s in slope), *(F.sum(w * curve[i, j]) for i in range(k) for j in range(i, k))]
        row = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        if not row[0] or any(s is None for s in row):
            return math.inf, np.zeros(k), np.eye(k)
        means = np.array(row[1:], float) / row[0]
        gradient = -means[1 : k + 1] + 2 * penalty * point
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = -means[k + 1 :]
        hessian = hessian + np.triu(hessian, 1).T + 2 * penalty * np.eye(k)
        # The chain rule of exp.
        return -means[0] + penalty * float(point @ point), gradient * point, hessian * np.outer(point, point) + np.diag(gradient * point)

    return at


def newton(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: Sequence[float], rounds: int, tol: float = 1e-6):
    """(point, rounds, largest slope, converged): Newton steps within a trust radius, one evaluation each.

    A step that does not lower the loss is taken back and the radius shrinks; convergence is a slope below ``tol``.
    """
    x = np.asarray(start, float)
    loss, gradient, hessian = evaluate(x)
    radius, done = 2.0, 0
    for done in range(1, rounds + 1):
        if np.abs(gradient).max() < tol or not np.isfinite(loss):
            done -= 1
            break
        values, vectors = np.linalg.eigh(hessian)
        step = -vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, radius / max(np.abs(step).max(), 1e-300))
        tried = evaluate(x + step)
        # Near the optimum losses agree to rounding; there a smaller slope decides.
        lower = tried[0] < loss or (tried[0] <= loss + 1e-12 * max(1.0, abs(loss)) and np.abs(tried[1]).max() < np.abs(gradient).max())
        if np.isfinite(tried[0]) and lower:
            x, (loss, gradient, hessian) = x + step, tried
            radius = min(2.0, radius * 2)
        else:
            radius = min(radius, float(np.abs(step).max())) / 4
            if radius < 1e-9:
                break
    slope = float(np.abs(gradient).max())
    return x, done, slope, bool(slope < tol and np.isfinite(loss))


def _fitted(table: DataFrame, terms, penalty: float, k: int, rounds: int) -> tuple[np.ndarray, tuple[int, float, bool]]:
    x, done, slope, converged = newton(penalised(staged(table, "distinct"), terms, penalty), [0.0] * k, rounds)
    if not converged:
        warnings.warn(f"no convergence in {done} rounds, largest slope {slope:.3g}", stacklevel=3)
    return np.exp(x), (done, slope, converged)


def frequency_table(summary: DataFrame, scale: float) -> DataFrame:
    """Distinct (frequency, recency, T) with counts, times multiplied by ``scale``: bounded by the calendar, not by customers."""
    counted = summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counted.select(F.col("frequency").cast("double").alias("x"), (F.col("recency") * scale).alias("tx"), (F.col("T") * scale).alias("t"), "weight")


def spend_table(summary: DataFrame) -> DataFrame:
    """Distinct (frequency, value) of repeat buyers with positive value."""
    repeat = summary.filter((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    return repeat.groupBy(F.col("frequency").cast("double").alias("x"), F.col("monetary_value").cast("double").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit_frequency_model(summary: DataFrame, penalty: float = 0.1, rounds: int = 50) -> FrequencyModel:
    """Penalised maximum likelihood; time is rescaled to at most 10 for conditioning and scaled back afterwards."""
    scale = 10.0 / (summary.agg(F.max("T")).first()[0] or 10.0)
    (r, alpha, a, b), ending = _fitted(frequency_table(summary, scale), frequency_terms, penalty, 4, rounds)
    return FrequencyModel(float(r), float(alpha / scale), float(a), float(b), *ending)


def fit_spend_model(summary: DataFrame, penalty: float = 0.01, rounds: int = 50) -> SpendModel:
    """Penalised maximum likelihood of spend on repeat buyers with positive value."""
    point, ending = _fitted(spend_table(summary), spend_terms, penalty, 3, rounds)
    return SpendModel(*(float(v) for v in point), *ending)


def model_equations(summary: DataFrame, frequency: FrequencyModel, spend: SpendModel, penalties: tuple[float, float] = (0.1, 0.01)) -> DataFrame:
    """model, customers and gradient: the largest slope of each model's penalised loss, evaluated anew over the summary."""
    scale = 10.0 / (summary.agg(F.max("T")).first()[0] or 10.0)
    tables = frequency_table(summary, scale), spend_table(summary)
    points = [frequency.r, frequency.alpha * scale, frequency.a, frequency.b], [spend.p, spend.q, spend.v]
    rows = []
    for name, table, terms, point, penalty in zip(("frequency", "spend"), tables, (frequency_terms, spend_terms), points, penalties):
        _, gradient, _ = penalised(table, terms, penalty)(np.log(point))
        rows.append((name, int(table.agg(F.sum("weight")).first()[0] or 0), float(np.abs(gradient).max())))
    return summary.sparkSession.createDataFrame(rows, "model string, customers long, gradient double")


def model_table(spark: SparkSession, frequency: FrequencyModel, spend: SpendModel, generation: int = 0) -> DataFrame:
    """Both models as one parameter row, ready to be saved with its generation; how the fits ended stands beside."""
    row, names = [generation], ["generation int"]
    for model in (frequency, spend):
        row += [getattr(model, f.name) for f in fields(model) if f.name not in _ENDING]
        names += [f"{f.name} double" for f in fields(model) if f.name not in _ENDING]
    for prefix, model in (("frequency", frequency), ("spend", spend)):
        row += [model.rounds, float(model.gradient), model.converged]
        names += [f"{prefix}_rounds int", f"{prefix}_gradient double", f"{prefix}_converged boolean"]
    return spark.createDataFrame([tuple(row)], ", ".join(names))
