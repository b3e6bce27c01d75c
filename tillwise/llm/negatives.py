"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt in blocks, each with its least spanning tree. A task takes one block through a run of candidates: scores at
the root are exact; at a child they lie within the parent's scores plus or minus the length of the edge times the
candidate's norm. Only candidates whose interval reaches into a wanted window are rescored, which makes their interval a
point for the children. A first walk finds each anchor's positives (window: from the k-th best score up), a second one
the negatives whose scores lie in the window of a positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.llm.topk import quantized
from tillwise.session import staged

ANCHORS, BLOCK = 512, 4096
#: Candidates that one task compares with one block of anchors.
RUN = 16_384
BLOCKS = "dimensions long, part long, ids binary, labels binary, data binary, tops array<array<long>>"
LONG = 2**63 - 1


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` vectors of (place, vector, id, label, tops); ``part`` deals them out to runs."""
    from pyspark import TaskContext

    held: dict[int, list] = {}
    serial = TaskContext.get().partitionId() * 7919

    def block(d: int) -> pa.RecordBatch:
        nonlocal serial
        rows = held.pop(d)
        serial += 1
        data = np.stack([x for x, *_ in rows]).T if d else np.empty((0, len(rows)))
        binary = [np.array([r[i] for r in rows], "<i8").tobytes() for i in (1, 2)]
        columns = [[d], [serial % parts], *([b] for b in binary), [np.ascontiguousarray(data, "<f8").tobytes()], [[r[3] or [] for r in rows]]]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["dimensions", "part", "ids", "labels", "data", "tops"])

    for batch in batches:
        names, labels, tops = (batch.column(i).to_pylist() for i in (1, 2, 3))
        placed = pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), batch.column(0)], names=["at", "v"])
        for d, (places, rows) in quantized(placed, scale).items():
            for at, x in zip(places, rows):
                own = held.setdefault(d, [])
                own.append((x, names[at], labels[at], tops[at]))
                if len(own) == size:
                    yield block(d)
    for d in list(held):
        yield block(d)


def _unpack(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["data"], "<f8").reshape(d, len(ids))


def spanning_tree(a: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, edge length) of the least spanning tree of columns, parents before children, depth first; root's parent is -1."""
    n = a.shape[1]
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    now = 0
    for _ in range(n):
        left[now] = False
        if parent[now] >= 0:
            children[parent[now]].append(now)
        length = np.sqrt(((a - a[:, now : now + 1]) ** 2).sum(axis=0))
        closer = left & (length < near)
        near[closer], parent[closer] = length[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
    order, stack = [], [0] if n else []
    while stack:
        now = stack.pop()
        order.append((now, int(parent[now]), float(near[now]) if parent[now] >= 0 else 0.0))
        stack += reversed(children[now])
    return order


class Window:
    """The k best (score, id) of scores between two bounds, ties to the smaller id."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows: list[tuple[int, int]] = []

    def overlaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high >= self.low) & (low <= self.high)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        inside = (score >= self.low) & (score <= self.high)
        ids, score = ids[inside], score[inside]
        best = np.lexsort((ids, -score))[: self.k]
        self.rows = sorted([*self.rows, *((-int(s), int(i)) for s, i in zip(score[best], ids[best]))])[: self.k]
        if len(self.rows) == self.k:
            self.low = max(self.low, -self.rows[-1][0])


def _exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers too large for doubles, kept within the range of long."""
    left = [int(v) for v in a]
    return np.array([max(-LONG - 1, min(LONG, sum(p * int(q) for p, q in zip(left, column)))) for column in x.T], np.int64)


def walk(tree: list, a: np.ndarray, x: np.ndarray, wanted, windows: list[list[Window]], ids: np.ndarray) -> int:
    """Fill the anchors' windows from one block of candidates; ``wanted(anchor)`` masks those that may count. Returns rescored pairs."""
    n, rescored = x.shape[1], 0
    large = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(a)) >= 2**52
    norm = np.sqrt((x**2).sum(axis=0)) * (1 + 1e-9)
    waiting: dict[int, int] = {}
    for _, p, _ in tree:
        waiting[p] = waiting.get(p, 0) + 1
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for anchor, p, length in tree:
        mask = wanted(anchor)
        if large:
            places = np.nonzero(mask)[0] if windows[anchor] else np.empty(0, int)
            score = _exact(a[:, anchor], x[:, places])
        else:
            if p < 0:
                low = high = a[:, anchor] @ x
            else:
                reach = length * norm + 1e-3  # the margin covers rounding
                low, high = state[p][0] - reach, state[p][1] + reach
            near = np.zeros(n, bool)
            for w in windows[anchor]:
                near |= w.overlaps(low, high)
            places = np.nonzero(near & mask)[0]
            if p < 0:
                score = low[places].astype(np.int64)
            elif len(places) * 4 > n:  # most are rescored: the whole product is cheaper than gathering
                low = high = a[:, anchor] @ x
                score = low[places].astype(np.int64)
                rescored += n
            else:
                value = a[:, anchor] @ x[:, places]
                low[places] = high[places] = value
                score = value.astype(np.int64)
                rescored += len(places)
            if waiting.get(anchor):
                state[anchor] = (low, high)
            if p >= 0:
                waiting[p] -= 1
                if not waiting[p]:
                    state.pop(p)
        for w in windows[anchor]:
            w.add(ids[places], score)
    return rescored


def _mine(anchors: pa.Table, candidates: pa.Table, k: int, percent: tuple[int, int] | None) -> pa.Table:
    out: tuple[list, ...] = ([], [], [], [])
    blocks = candidates.to_pylist()
    for row in anchors.to_pylist():
        d = row["dimensions"]
        a_ids, a_labels, a = _unpack(row, d)
        tree = spanning_tree(a)
        if percent is None:
            windows = [[Window(-LONG - 1, LONG, k)] for _ in a_ids]
        else:
            # low% of the positive's score, rounded up, to high%, rounded down; nothing if that is empty.
            windows = [[Window(-((-percent[0] * s) // 100), percent[1] * s // 100, k) for s in tops] for tops in row["tops"]]
        for other in blocks:
            ids, labels, x = _unpack(other, d)
            same = {label: labels == label for label in set(a_labels.tolist())}

            def wanted(i):
                own = same[int(a_labels[i])]
                return own & (ids != a_ids[i]) if percent is None else ~own

            walk(tree, a, x, wanted, windows, ids)
        for i, own in zip(a_ids.tolist(), windows):
            for number, w in enumerate(own, 1):
                for minus, name in w.rows:
                    out[0].append(i), out[1].append(number), out[2].append(name), out[3].append(-minus)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "top", "vec_id", "score"])


def _walked(anchors: DataFrame, right: DataFrame, n_anchors: int, runs: int, scale: float, k: int, percent) -> DataFrame:
    """(anchor_id, top, vec_id, score, rank) of the k best candidates per anchor and window."""
    parts = max(1, math.ceil(n_anchors / ANCHORS))
    # Anchors of one label that point the same way come into one block, which shortens the edges of its tree.
    dealt = anchors.repartitionByRange(parts, "label", F.try_element_at("v", F.lit(1)), "id") if parts > 1 else anchors.coalesce(1)
    left = dealt.select("v", "id", "label", "tops").mapInArrow(lambda it: _blocks(it, scale, ANCHORS, 1), BLOCKS)
    left = staged(left.withColumn("block", F.monotonically_increasing_id()), "anchors")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    met = right.join(left.select(*(F.col(c).alias(c) for c in ("dimensions", "part", "block"))), ["dimensions", "part"])
    keys = ["dimensions", "part", "block"]
    schema = "anchor_id long, top long, vec_id long, score long"
    found = left.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda a, b: _mine(a, b, k, percent), schema)
    rank = F.row_number().over(W.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100),
    scale: float = 256.0, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components are floor(scale * x), scores inner products; higher scores come first, ties by smaller id. An anchor's positives
    are its first other rows of the same label; each has as negatives the first rows of other labels whose score is at least
    ``percent[0]`` and at most ``percent[1]`` hundredths of the positive's score. Labels are whole numbers.

    Rows with a null id, label or vector, or any null or non-finite component take no part. Vectors meet those with as many dimensions.
    Rows that repeat an id each count as candidates, never for the anchor of that id as positive; of anchors with one id
    the row of smallest vector, then label, stands. Too few partners give fewer rows, empty tables none. Extra columns are
    ignored. Scores beyond the range of long are set to its end.
    """
    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)

    first = usable(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("row")).select("id", "row.label", "row.v")
    first = staged(first, "anchor-rows")
    every = usable(vectors)
    n_anchors, n_rows = first.count(), every.count()
    runs = max(1, math.ceil(n_rows / RUN))
    size = max(64, min(BLOCK, math.ceil(n_rows / (4 * runs))))
    none = F.lit(None).cast("array<long>").alias("tops")
    right = staged(every.select("v", "id", "label", none).mapInArrow(lambda it: _blocks(it, scale, size, runs), BLOCKS), "candidates")
    tops = _walked(first.withColumn("tops", none), right, n_anchors, runs, scale, positives, None)
    tops = staged(tops.select("anchor_id", F.col("rank").cast("long").alias("top"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = tops.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("top", "positive_score"))), lambda s: s["positive_score"]).alias("tops"))
    found = _walked(first.join(windows, "id"), right, n_anchors, runs, scale, negatives, percent)
    return found.join(tops, ["anchor_id", "top"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
