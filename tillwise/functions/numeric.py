"""Numeric expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def zero_as_one(col: Column) -> Column:
    return F.when(col == 0, F.lit(1.0)).otherwise(col.cast("double"))


def lgamma(z: Column) -> Column:
    """log Gamma for positive arguments: shift by eight, then Stirling's series."""
    shifted = z + F.lit(8.0)
    inv = F.lit(1.0) / shifted
    inv2 = inv * inv
    series = inv * (
        F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680)))
    )
    stirling = (
        (shifted - F.lit(0.5)) * F.log(shifted)
        - shifted
        + F.lit(0.5 * math.log(2 * math.pi))
        + series
    )
    product = z
    for k in range(1, 8):
        product = product * (z + F.lit(float(k)))
    return stirling - F.log(product)


def digamma(z: Column) -> Column:
    """Derivative of ``lgamma`` for positive arguments: shift by eight, then the asymptotic series."""
    y = z + F.lit(8.0)
    inv2 = F.lit(1.0) / (y * y)
    series = inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * (F.lit(1 / 252) - inv2 * (F.lit(1 / 240) - inv2 * F.lit(1 / 132)))))
    out = F.log(y) - F.lit(0.5) / y - series
    for k in range(8):
        out = out - F.lit(1.0) / (z + F.lit(float(k)))
    return out


def trigamma(z: Column) -> Column:
    """Second derivative of ``lgamma`` for positive arguments."""
    y = z + F.lit(8.0)
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    series = F.lit(1 / 6) - inv2 * (F.lit(1 / 30) - inv2 * (F.lit(1 / 42) - inv2 * (F.lit(1 / 30) - inv2 * F.lit(5 / 66))))
    out = inv + inv2 * (F.lit(0.5) + inv * series)
    for k in range(8):
        shifted = z + F.lit(float(k))
        out = out + F.lit(1.0) / (shifted * shifted)
    return out
