"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Vectors are stored dimension by dimension in blocks. A task meets one block of queries with a run of
candidate blocks: it adds up the scores one block of dimensions after another; after each, a candidate
survives for a query only if its partial score plus the largest product that the remaining dimensions
allow (the norms of what is left of both vectors) still reaches the query's k-th best score so far.
Survivors are compacted, so later dimensions are read for them alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.session import staged

BLOCK = 4096
QUERY_BLOCK = 1024
#: Candidates that one task compares with one block of queries.
RUN = 16_384
DIMENSIONS = 16
BLOCKS = "dimensions long, part long, ids binary, data binary"


def quantized(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[list, list]]:
    """Ids and floor(scale * x) of the usable vectors, by number of dimensions."""
    groups: dict[int, tuple[list, list]] = {}
    for i, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
        if not vector.is_valid or i is None or vector.values.null_count:
            continue
        x = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            ids, rows = groups.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(x)
    return groups


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Vertical blocks of at most ``size`` vectors; ``part`` deals them out to runs."""
    from pyspark import TaskContext

    held: dict[int, tuple[list, list]] = {}
    serial = TaskContext.get().partitionId() * 7919

    def block(d: int) -> pa.RecordBatch:
        nonlocal serial
        ids, rows = held.pop(d)
        serial += 1
        data = np.stack(rows).T if d else np.empty((0, len(ids)))
        small = not data.size or np.abs(data).max() < 2**15
        packed = (b"s" if small else b"d") + np.ascontiguousarray(data, "<i2" if small else "<f8").tobytes()
        columns = [[d], [serial % parts], [np.asarray(ids, "<i8").tobytes()], [packed]]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["dimensions", "part", "ids", "data"])

    for batch in batches:
        for d, (ids, rows) in quantized(batch, scale).items():
            for i, x in zip(ids, rows):
                own = held.setdefault(d, ([], []))
                own[0].append(i)
                own[1].append(x)
                if len(own[0]) == size:
                    yield block(d)
    for d in list(held):
        yield block(d)


def unpack(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(data, "<i2" if data[:1] == b"s" else "<f8", offset=1).reshape(d, len(names)).astype(np.float64)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        begins = np.nonzero(np.r_[True, query[1:] != query[:-1]])[0] if len(query) else []
        for i, j in zip(begins, [*begins[1:], len(query)]):
            q, j = query[i], min(j, i + self.k)
            rows = sorted([*self.rows[q], *zip((-score[i:j]).tolist(), ids[i:j].tolist())])[: self.k]
            self.rows[q] = rows
            if len(rows) == self.k:
                self.least[q] = -rows[-1][0]


def bounded_scan(best: Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, step: int = DIMENSIONS) -> None:
    """Exact scores of all candidates that may belong to the best; ``q`` and ``c`` are (dimension, vector)."""
    d = len(q)
    cuts = [*range(0, d, step), d]
    rest_q = {i: np.sqrt((q[i:] ** 2).sum(axis=0)) for i in cuts}
    rest_c = {i: np.sqrt((c[i:] ** 2).sum(axis=0)) for i in cuts}
    end = cuts[1] if d else 0
    partial = q[:end].T @ c[:end]
    # The bound is computed in floating point; a relative and absolute margin keeps it a bound.
    bound = partial + np.outer(rest_q[end], rest_c[end]) * (1 + 1e-9) + 1
    qi, ci = np.nonzero((bound >= best.least[:, None]) & (q_ids[:, None] != c_ids[None, :]))
    score = partial[qi, ci]
    for low, high in zip(cuts[1:-1], cuts[2:]):
        if not len(qi):
            return
        if len(qi) * 8 > partial.size:  # most survive: the dense product is cheaper than gathering
            partial += q[low:high].T @ c[low:high]
            score = partial[qi, ci]
        else:
            for x in range(low, high):
                score = score + q[x, qi] * c[x, ci]
            partial[qi, ci] = score
        alive = score + rest_q[high][qi] * rest_c[high][ci] * (1 + 1e-9) + 1 >= best.least[qi]
        qi, ci, score = qi[alive], ci[alive], score[alive]
    best.add(qi, c_ids[ci], score)


def exact_scan(best: Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> None:
    """For values whose sums may pass 2**53: Python integers, kept within the range of long."""
    left = [[int(x) for x in column] for column in q.T]
    right = [[int(x) for x in column] for column in c.T]
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if q_ids[i] != c_ids[j]:
                score = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
                best.rows[i] = sorted([*best.rows[i], (-score, int(c_ids[j]))])[: best.k]


def _search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    out = ([], [], [])
    for d, ids, data in zip(*(queries.column(n).to_pylist() for n in ("dimensions", "ids", "data"))):
        q_ids, q = unpack(ids, data, d)
        best = Best(len(q_ids), k)
        for c_raw, c_data in zip(*(candidates.column(n).to_pylist() for n in ("ids", "data"))):
            c_ids, c = unpack(c_raw, c_data, d)
            most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(d, 1)
            if most < 2**52:
                bounded_scan(best, q_ids, q, c_ids, c)
            else:
                exact_scan(best, q_ids, q, c_ids, c)
                best.least = np.full(len(q_ids), -np.inf)
        for i, rows in zip(q_ids.tolist(), best.rows):
            for minus, name in rows:
                out[0].append(i), out[1].append(name), out[2].append(-int(minus))
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def top_matches(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` largest inner products.

    Components are floor(scale * x), scores integers; ties go to the smaller vec_id; a query never meets rows with
    its own id. Vectors that are null, or hold a null or a component that is not finite, take no part, nor do
    rows without id. Vectors meet those with as many dimensions. Each id should name one row: of several queries with
    one id the first met is used, repeated candidates each count. Fewer than ``k`` partners give fewer rows; an empty
    table, or none left, gives none. Extra columns are ignored. Scores beyond the range of long are set to its end.

    Queries and candidates are dealt in blocks to a grid of tasks: queries move once per run of candidates and
    candidates once per block of queries; each task returns k rows per query.
    """
    chosen = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).dropDuplicates(["id"])
    every = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    n_queries, n_rows = chosen.count(), every.count()
    q_blocks, runs = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_rows / RUN))
    # Enough blocks that each run gets several; small tables give small blocks.
    size = max(64, min(BLOCK, math.ceil(n_rows / (4 * runs))))
    left = chosen.repartition(q_blocks, F.pmod(F.xxhash64("id"), F.lit(q_blocks))).mapInArrow(lambda it: _blocks(it, scale, QUERY_BLOCK, 1), BLOCKS)
    left = staged(left.withColumn("q", F.monotonically_increasing_id()), "queries")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    right = every.mapInArrow(lambda it: _blocks(it, scale, size, runs), BLOCKS)
    wanted = left.select(*(F.col(c).alias(c) for c in ("dimensions", "part", "q")))  # new names for a second role
    right = right.join(wanted, ["dimensions", "part"])
    keys = ["dimensions", "part", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
