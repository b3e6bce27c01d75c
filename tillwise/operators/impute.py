"""Chained regression imputation from moments of missing patterns.

Rows that lack the same columns form a pattern. A regression fill is linear in a row's other values, so after any number
of rounds a filled row is one matrix times its observed values, the same for all rows of its pattern. The sums of cross
products of each pattern's observed values, taken once, therefore give every regression of every round: the driver
works on k x k matrices only, complete rows are read once, and rows with gaps meet their pattern's matrix at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillwise.session import staged

# Doubles held at once, by the driver for rounds that wait and by a task for one block of rows.
_CELLS = 1 << 20


def _values(columns: Sequence[str]) -> list[Column]:
    """The columns as doubles; NaN counts as missing."""
    doubles = [F.col(c).cast("double") for c in columns]
    return [F.when(~F.isnan(x), x) for x in doubles]


def _pattern(columns: Sequence[str]) -> Column:
    return F.concat(*[F.when(x.isNull(), "1").otherwise("0") for x in _values(columns)])


def _observed(columns: Sequence[str]) -> Column:
    """One, then the observed values, zero where missing."""
    return F.array(F.lit(1.0), *[F.coalesce(x, F.lit(0.0)) for x in _values(columns)])


def _dot(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)


@dataclass
class Imputation:
    """Fills by pattern and the last regression of each incomplete column.

    ``equations`` maps a column to its weights of one and of all columns (its own is zero). ``change`` is the last
    round's largest change, or a bound of it that settles the matter; ``converged`` says whether it fell below the tolerance.
    """

    columns: list[str]
    targets: list[str]
    fills: dict[str, np.ndarray]
    equations: dict[str, np.ndarray]
    rounds: int = 0
    change: float = 0.0
    converged: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns as doubles and all gaps filled; other columns and observed cells stay."""
        doubles = dict(zip(self.columns, _values(self.columns)))
        if not self.targets:
            return df.withColumns(doubles)
        pattern, fill, row = "_pattern", "_fill", "_observed"
        while {c.lower() for c in df.columns} & {pattern, fill, row}:
            pattern, fill, row = (f"{n}_" for n in (pattern, fill, row))
        table = _by_pattern(df.sparkSession, self.fills, pattern, fill)
        known = df.withColumns({pattern: _pattern(self.columns), row: _observed(self.columns)}).join(table, pattern, "left")
        filled = {c: F.coalesce(x, _dot(F.get(fill, F.lit(self.columns.index(c) + 1)), F.col(row))) if c in self.targets else x for c, x in doubles.items()}
        return known.withColumns(filled).select(*[F.col(f"`{c}`") for c in df.columns])


def _by_pattern(spark, matrices: dict[str, np.ndarray], pattern: str, name: str) -> DataFrame:
    """One row per pattern; small enough to be sent along for all but very many incomplete columns, joined otherwise."""
    rows = [(p, m.tolist()) for p, m in matrices.items()]
    return spark.createDataFrame(rows, f"{pattern} string, {name} array<array<double>>")


def fit_imputation(df: DataFrame, columns: Sequence[str], rounds: int = 10, tol: float = 1e-3, ridge: float = 1e-6) -> Imputation:
    """Regress each incomplete column on all others, in rounds, starting from the column means.

    Columns take turns by their number of gaps; a regression uses the rows in which its column is observed, the other gaps
    as filled so far, and a ridge relative to each column's scale. One aggregate per pattern gives all moments, one small
    scan of the rows with gaps the largest changes of several rounds where the moments leave them open. Stops when that is below ``tol`` times the largest observed
    value. Patterns are as many as occur, at most 2 to the number of incomplete columns. A column without any value
    becomes 0; no rows or no gaps give no fills.
    """
    names = list(columns)
    k = len(names) + 1
    row, pattern = _observed(names), _pattern(names)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    z = [F.col("z")[i] for i in range(k)]
    rows = df.select(pattern.alias("pattern"), row.alias("z"))
    moments = rows.groupBy("pattern").agg(
        F.array(*[F.sum(z[i] * z[j]) for i, j in upper]).alias("m"), F.max(F.array_max(F.transform("z", F.abs))).alias("top")
    ).collect()
    sums: dict[str, np.ndarray] = {}
    for r in moments:
        gram = np.zeros((k, k))
        for (i, j), v in zip(upper, r["m"]):
            gram[i, j] = gram[j, i] = v
        sums[r["pattern"]] = gram
    lacks = {p: [i + 1 for i, bit in enumerate(p) if bit == "1"] for p in sums}
    gaps = {i: sum(sums[p][0, 0] for p in sums if i in lacks[p]) for i in range(1, k)}
    order = sorted((i for i in gaps if gaps[i] > 0), key=lambda i: gaps[i])
    if not order:
        return Imputation(names, [], {}, {})

    matrices = {}
    for p in sums:
        matrix = np.eye(k)
        for i in lacks[p]:
            seen = [q for q in sums if i not in lacks[q]]
            n = sum(sums[q][0, 0] for q in seen)
            matrix[i] = 0
            matrix[i, 0] = sum(sums[q][0, i] for q in seen) / n if n else 0.0
        matrices[p] = matrix
    open_rows = staged(rows.filter(F.col("pattern").contains("1")), "gaps")
    limit = tol * (max(r["top"] for r in moments) or 1.0)
    result = Imputation(names, [names[i - 1] for i in order], {}, {}, converged=False)
    # Rounds that the moments leave open wait and are settled together: rounds go on without the rows, and the first one
    # below the limit counts. What waits stays small, so very many patterns are settled round by round.
    room = max(1, min(64, _CELLS // (len(lacks) * k * k)))
    waiting, together = [], min(8, room)
    for result.rounds in range(1, rounds + 1):
        before = {p: m.copy() for p, m in matrices.items() if lacks[p]}
        for target in order:
            total = sum((matrices[p] @ sums[p] @ matrices[p].T for p in sums if target not in lacks[p]), np.zeros((k, k)))
            others = [i for i in range(k) if i != target]
            scale = np.sqrt(np.maximum(np.diag(total)[others], 1e-300))
            lhs = total[np.ix_(others, others)] / np.outer(scale, scale) + ridge * np.eye(k - 1)
            weights = np.zeros(k)
            weights[others] = np.linalg.solve(lhs, total[others, target] / scale) / scale
            result.equations[names[target - 1]] = weights
            for p in before:
                if target in lacks[p]:
                    matrices[p][target] = weights @ matrices[p]
        deltas = {p: matrices[p][lacks[p]] - m[lacks[p]] for p, m in before.items()}
        # Sums of squared changes bound the largest one from both sides; rows are asked only if that leaves it open.
        squares = {p: np.maximum(np.einsum("ci,ij,cj->c", d, sums[p], d), 0.0).max() for p, d in deltas.items()}
        least, most = max(math.sqrt(v / sums[p][0, 0]) for p, v in squares.items()), math.sqrt(max(squares.values()))
        sure = most < limit and least < limit
        if least >= limit:
            result.change = least
        elif sure:
            result.change = most
        else:
            waiting.append((result.rounds, deltas, {p: matrices[p].copy() for p in before}, dict(result.equations)))
        if waiting and (sure or result.rounds == rounds or len(waiting) >= together):
            changes = _largest_changes(open_rows, [w[1] for w in waiting], k)
            settled = next((i for i, c in enumerate(changes) if c < limit), None)
            if settled is not None:
                result.rounds, _, result.fills, result.equations = waiting[settled]
                result.change, result.converged = changes[settled], True
                return result
            if waiting[-1][0] == result.rounds:
                result.change = changes[-1]
            waiting, together = [], min(2 * together, room)
        if sure:
            result.converged = True
            break
    result.fills = {p: matrices[p] for p in before}
    return result


def _largest_changes(rows: DataFrame, deltas: Sequence[dict[str, np.ndarray]], k: int) -> list[float]:
    """The largest change of a cell in each of several rounds, in one scan of ``rows`` (pattern, z of ``k`` values)."""
    stacked = {p: np.concatenate([d[p] for d in deltas]).T for p in deltas[0]}
    rounds = len(deltas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(rounds)
        for batch in batches:
            patterns = batch.column("pattern").dictionary_encode()
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            codes = patterns.indices.to_numpy(zero_copy_only=False)
            for code, p in enumerate(patterns.dictionary.to_pylist()):
                mine, step = z[codes == code], max(1, _CELLS // stacked[p].shape[1])
                for at in range(0, len(mine), step):
                    moved = np.abs(mine[at : at + step] @ stacked[p]).max(axis=0)
                    top = np.maximum(top, moved.reshape(rounds, -1).max(axis=1))
        yield pa.RecordBatch.from_pydict({"round": pa.array(range(rounds), pa.int32()), "change": pa.array(top, pa.float64())})

    found = rows.select("pattern", "z").mapInArrow(run, "round int, change double").groupBy("round").agg(F.max("change").alias("change"))
    by_round = {r["round"]: r["change"] for r in found.collect()}
    return [by_round.get(i, 0.0) for i in range(rounds)]


def equation_check(df: DataFrame, filled: DataFrame, model: Imputation, keys: Sequence[str]) -> DataFrame:
    """Per incomplete column: target, filled (cells), changed (observed cells that are not as before), misfit and residual.

    ``misfit`` is the largest distance of a filled cell from its regression, as a share of the largest value; ``residual``
    the largest normal equation of the regression over the observed rows, scaled by the lengths of its two sides.
    """
    raw = df.select(*keys, *[x.alias(f"_raw_{c}") for c, x in zip(model.columns, _values(model.columns))])
    both = filled.join(raw, list(keys))
    one = [F.lit(1.0), *[F.col(c) for c in model.columns]]
    top = F.max(F.greatest(*[F.abs(F.col(c)) for c in model.columns], F.lit(0.0)))
    table = []
    for target in model.targets:
        guess = F.lit(0.0)
        for w, x in zip(model.equations[target], one):
            guess = guess + F.lit(float(w)) * x
        was, y = F.col(f"_raw_{target}"), F.col(target)
        left = F.when(was.isNotNull(), y - guess)
        size = lambda x: F.sqrt(F.sum(F.when(was.isNotNull(), x * x)))  # noqa: B023, E731
        sides = [F.try_divide(F.abs(F.sum(left * x)), size(x) * size(y)) for x, c in zip(one, ["", *model.columns]) if c != target]
        table.append(F.struct(
            F.lit(target).alias("target"), F.count_if(was.isNull() & y.isNotNull()).alias("filled"),
            F.count_if(was.isNotNull() & ~was.eqNullSafe(y)).alias("changed"),
            F.coalesce(F.max(F.when(was.isNull(), F.abs(y - guess))) / top, F.lit(0.0)).alias("misfit"),
            F.array_max(F.array(*sides)).alias("residual"),
        ))
    if not table:
        return both.select(F.inline(F.expr("CAST(array() AS array<struct<target:string,filled:bigint,changed:bigint,misfit:double,residual:double>>)")))
    return both.agg(F.array(*table).alias("all")).select(F.inline("all"))
