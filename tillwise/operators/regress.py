"""Grouped least squares: moments are aggregated by Spark, only k x k systems are solved.

Each group's cross products are plain sums, so they combine map-side and a group
owning most of the rows costs no more than any other. After one shuffle a group
is a single row; Arrow batches of such rows are solved together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def moments(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, weight: str | None = None
) -> DataFrame:
    """Per key: upper triangle of X'X, X'y, y'y, sum of y and row count."""
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(x)
    xtx = [F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]
    xty = [F.sum(w * xi * y) for xi in x]
    complete = df.na.drop(subset=[*features, target])
    return complete.groupBy(*keys).agg(
        F.array(*xtx).alias("xtx"),
        F.array(*xty).alias("xty"),
        F.sum(w * y * y).alias("yy"),
        F.sum(w * y).alias("sy"),
        F.count(F.lit(1)).alias("n"),
    )


def kernels():
    """Small dense helpers, built as closures so that tasks need no local import."""

    def unpack(flat, k: int) -> np.ndarray:
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = np.asarray(flat, float)
        return full + np.triu(full, 1).T

    def answer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Solve a symmetric system; rank-deficient ones get the minimum-norm answer."""
        scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
        scaled = a / np.outer(scale, scale)
        return (np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) @ (b / scale)) / scale

    return unpack, answer


def solve(gram: DataFrame, keys: Sequence[str], k: int, ridge: Sequence[float] | float = 0.0) -> DataFrame:
    """Coefficients, squared error and R2 per key from :func:`moments` rows."""
    penalty = np.diag(np.full(k, float(ridge)) if np.isscalar(ridge) else np.asarray(ridge, float))
    schema = T.StructType(
        [gram.schema[c] for c in keys]
        + [
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("sse", T.DoubleType()),
            T.StructField("r2", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )
    keys = list(keys)
    unpack, answer = kernels()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                xtx, xty, yy, sy, n = row[len(keys):]
                a, b = unpack(xtx, k), np.asarray(xty, float)
                beta = answer(a + penalty, b)
                sse = max(float(yy - 2 * beta @ b + beta @ a @ beta), 0.0)
                spread = yy - sy * sy / n
                r2 = 1 - sse / spread if spread > 0 else None
                rows.append([*row[: len(keys)], beta.tolist(), sse, r2, int(n)])
            yield pd.DataFrame(rows, columns=[*keys, "coefficients", "sse", "r2", "n"])

    return gram.select(*keys, "xtx", "xty", "yy", "sy", "n").mapInPandas(run, schema)


def least_squares(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    ridge: Sequence[float] | float = 0.0,
    weight: str | None = None,
) -> DataFrame:
    """One linear model per key; ``features`` must include a constant column if wanted."""
    return solve(moments(df, keys, features, target, weight), keys, len(features), ridge)


def named_coefficients(models: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (keys, feature, coefficient)."""
    return models.select(
        *keys,
        F.explode(
            F.arrays_zip(
                F.array(*[F.lit(f) for f in features]).alias("feature"),
                F.col("coefficients").alias("coefficient"),
            )
        ).alias("c"),
    ).select(*keys, "c.feature", "c.coefficient")


def dot(coefficients: Column, features: Sequence[Column]) -> Column:
    """Unrolled dot product of a coefficient array with feature columns."""
    total = F.lit(0.0)
    for i, f in enumerate(features):
        total = total + F.get(coefficients, F.lit(i)) * f
    return total


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation from the uncentred cross products: G_ii * inv(G)_ii."""
    k = len(features)
    gram = moments(df.withColumn("_y", F.lit(0.0)), [], features, "_y")
    schema = "feature string, vif double"
    unpack, _ = kernels()
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for flat in batch["xtx"]:
                g = unpack(flat, k)
                values = np.diag(g) * np.diag(np.linalg.pinv(g, hermitian=True))
                yield pd.DataFrame({"feature": names, "vif": values})

    return gram.select("xtx").mapInPandas(run, schema)


def simple_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y on one regressor per key."""
    models = least_squares(df.withColumn("_one", F.lit(1.0)), keys, ["_one", x], y)
    return models.select(
        *keys,
        F.get("coefficients", F.lit(0)).alias("intercept"),
        F.get("coefficients", F.lit(1)).alias("slope"),
        "n",
    )
