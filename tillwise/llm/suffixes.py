"""Remove passages that occur earlier, by longest previous factors in suffix order.

Every ``length``-byte string holds an anchor, its smallest hashed gram, so two equal strings hold the same
anchor at the same offset. Anchors that occur once in the corpus are dropped; what is left is compared
group by group:

* Occurrences with the same whole surroundings: all but the first are covered.
* First occurrences of different surroundings: the bytes from the anchor on are put in suffix order, and so
  are the bytes before it, read backwards. Runs of neighbours that share enough bytes on both sides are the
  equal strings at one offset; in each run those with a previous smaller text position have a longest previous
  factor of ``length`` or more and are covered.

Only anchors and the surroundings of repeated ones move between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import staged

GRAM = 32
#: Anchors a task gathers before it drops later occurrences among them.
GATHER = 1_500_000
#: First occurrences of one anchor beyond which its windows are compared by Spark itself, row by row.
GROUP_LIMIT = 50_000
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = h * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on; ``gram`` is a multiple of eight."""
    n = len(data) - gram + 1
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    words = np.ascontiguousarray(words[: len(data)]).view("<u8").ravel()
    h = np.zeros(n, U)
    for i in range(0, gram, 8):
        h = mix(h ^ words[i : i + n])
    return h


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and surroundings' hashes of all grams that are smallest in some window."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    h, width = gram_hashes(data, gram), length - gram + 1
    least = sliding(h, width)
    edge = np.zeros(width - 1, U)
    at = np.nonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)[0]
    low, high = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(data))
    around = np.zeros(len(at), U)
    # Grams that together cover the surroundings from both ends; the sizes tell where they end.
    for i in range(0, 2 * length - gram, gram):
        around = mix(around ^ h[np.minimum(low + i, high - gram)])
    around = mix(around ^ (at - low).astype(U))
    return at, h[at], mix(around ^ ((high - low).astype(U) << U(20)))


def unite(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the overlapping or touching ranges of each key."""
    if not len(key):
        return key, low, high
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    first = np.r_[True, key[1:] != key[:-1]]
    # Shift each key's ranges beyond those of the key before, so one running maximum serves all.
    shift = (np.cumsum(first) - 1) * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    start = np.r_[True, (low + shift)[1:] > reach[:-1]]
    begins = np.nonzero(start)[0]
    ends = np.r_[begins[1:], len(key)] - 1
    return key[begins], low[begins], (reach - shift)[ends]


ROWS = "anchor long, around long, key long, low long, high long"


def _batch(anchor, around, key, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != U else x.view(np.int64)) for x in (anchor, around, key, low, high)],
        names=["anchor", "around", "key", "low", "high"],
    )


def _covers(key, low, high) -> pa.RecordBatch:
    """Covered ranges travel as rows without surroundings; their anchor only spreads them."""
    key, low, high = unite(key, low, high)
    return _batch(mix(key.astype(U) ^ (low.astype(U) << U(32))), np.zeros(len(key), U), key, low, high)


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """First occurrences within the task, and ranges covered because the task itself saw them before."""
    parts, count = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, at, anchor, around = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, key, around, anchor))
        key, at, anchor, around = key[order], at[order], anchor[order], around[order]
        later = np.r_[False, (anchor[1:] == anchor[:-1]) & (around[1:] == around[:-1])]
        yield _covers(key[later], np.maximum(at[later] - (length - GRAM), 0), at[later] + length)
        first = np.nonzero(~later)[0]
        for i in range(0, len(first), 100_000):
            f = first[i : i + 100_000]
            yield _batch(anchor[f], np.where(around[f] == 0, U(1), around[f]), key[f], at[f], np.full(len(f), -1))

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, anchor, around = anchors(np.frombuffer(text.as_py() or b"", np.uint8), length)
            if len(at):
                parts.append((np.full(len(at), key), at, anchor, around))
                count += len(at)
            if count >= GATHER:
                yield from flush()
                parts, count = [], 0
    if parts:
        yield from flush()


def _runs(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.Table]:
    """Tables of whole anchor groups from batches sorted by anchor."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= at_least:
            table = pa.Table.from_batches(held)
            anchor = table.column(0).to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield table.slice(0, cut)
                held, count = table.slice(cut).to_batches(), count - cut
    if count:
        yield pa.Table.from_batches(held)


def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (anchor, around, key, low): covered ranges, and first occurrences that need comparing.

    Streams: only the last row and the first occurrence of the open anchor are carried between batches.
    """
    last = None  # (anchor, around) of the row before
    first = None  # the open anchor's only first occurrence so far: (anchor, around, key, at)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, around, key, low, high = (batch.column(i).to_numpy() for i in range(5))
        ready = around == 0
        if ready.any():
            yield _batch(anchor[ready], around[ready], key[ready], low[ready], high[ready])
            anchor, around, key, low = (x[~ready] for x in (anchor, around, key, low))
        if not len(anchor):
            continue
        same_anchor = np.r_[last is not None and anchor[0] == last[0], anchor[1:] == anchor[:-1]]
        same = same_anchor & np.r_[last is not None and around[0] == last[1], around[1:] == around[:-1]]
        last = (anchor[-1], around[-1])
        yield _covers(key[same], np.maximum(low[same] - (length - GRAM), 0), low[same] + length)
        fresh = np.nonzero(~same)[0]
        rows = [x[fresh] for x in (anchor, around, key, low)]
        known = same_anchor[fresh]  # another surroundings of the same anchor came before
        if first is not None and len(fresh):
            rows = [np.r_[np.asarray([f], x.dtype), x] for f, x in zip(first, rows)]
            known = np.r_[False, known]
        if not len(rows[0]):
            continue
        several = known | np.r_[known[1:], False]
        # The last first occurrence stays open: the next batch may bring another surroundings of its anchor.
        several[-1] = known[-1]
        if several.any():
            yield _batch(*(x[several] for x in rows), np.full(int(several.sum()), -1))
        # If it was written already, keep a mark that its anchor has company by leaving it out.
        first = None if several[-1] else tuple(x[-1] for x in rows)


def _surroundings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes from each anchor on, and before it."""
    for batch in batches:
        out = ([], [], [], [], [])
        for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            data = text.as_py() or b""
            for mark in marks.as_py():
                at = mark["low"]
                for column, value in zip(out, (mark["anchor"], key, at, data[at : at + length], data[max(0, at - length + GRAM) : at])):
                    column.append(value)
        for i in range(0, len(out[0]), 20_000):
            part = [c[i : i + 20_000] for c in out]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names=["anchor", "key", "at", "after", "before"])


def suffix_order(group: np.ndarray, sides: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and the bytes each shares with the one before (-1: new group)."""
    size = np.fromiter(map(len, sides), np.int64, len(sides))
    padded = -(-width // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(padded, b"\0") for s in sides), np.uint8).reshape(len(sides), padded)
    words = table.view(">u8").astype(U)
    order = np.lexsort((size, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group))
    shared = np.full(len(sides), -1, np.int64)
    for i in range(0, len(order) - 1, 50_000):
        a, b = order[i : i + 50_000], order[i + 1 : i + 50_001]
        a = a[: len(b)]
        differ = table[a] != table[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), padded)
        common = np.minimum(common, np.minimum(size[a], size[b]))
        shared[i + 1 : i + 1 + len(b)] = np.where(group[a] == group[b], common, -1)
    return order, shared


def covered_windows(group: np.ndarray, key: np.ndarray, at: np.ndarray, after: list[bytes], before: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each ``length``-byte window through an anchor that also starts earlier in its group."""
    m = len(group)
    reach = np.fromiter(map(len, after), np.int64, m)
    back = np.fromiter(map(len, before), np.int64, m)
    right_order, right_shared = suffix_order(group, after, length)
    left_order, left_shared = suffix_order(group, [b[::-1] for b in before], length - GRAM)
    place = np.empty(m, np.int64)
    place[np.lexsort((at, key))] = np.arange(m)
    right, left = np.empty(m, np.int64), np.empty(m, np.int64)
    rows, starts = [], []
    for back_by in range(length - GRAM + 1):
        right[right_order] = np.cumsum(right_shared < length - back_by)
        left[left_order] = np.cumsum(left_shared < back_by)
        fit = np.nonzero((back >= back_by) & (reach >= length - back_by))[0]
        if len(fit) < 2:
            continue
        run = right[fit] * (m + 1) + left[fit]
        order = np.lexsort((place[fit], run))
        later = np.r_[False, run[order][1:] == run[order][:-1]]
        hit = fit[order[later]]
        rows.append(hit)
        starts.append(at[hit] - back_by)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, 30_000):
        group, key, at = (table.column(i).to_numpy() for i in range(3))
        row, start = covered_windows(group, key, at, table.column(3).to_pylist(), table.column(4).to_pylist(), length)
        k, low, high = unite(key[row], start, start + length)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(low), pa.array(high)], names=["key", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [], [], [])
        for doc_id, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            data, spans = text.as_py() or b"", ranges.as_py() or []
            low = np.fromiter((s["low"] for s in spans), np.int64, len(spans))
            high = np.fromiter((min(s["high"], len(data)) for s in spans), np.int64, len(spans))
            _, low, high = unite(np.zeros(len(spans), np.int64), low, high)
            kept, end = [], 0
            for a, b in zip(low.tolist(), high.tolist()):
                kept.append(data[end:a])
                end = b
            rest = b"".join([*kept, data[end:]])
            row = (doc_id, len(data), len(data) - len(rest), len(low), hashlib.sha256(rest).hexdigest(), rest if texts else None)
            for column, value in zip(out, row):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        arrays = [pa.array(c, t) for c, t in zip(out, types)]
        yield pa.RecordBatch.from_arrays(arrays if texts else arrays[:5], names=names if texts else names[:5])


def _large_groups(marked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Exact way for anchors with very many surroundings: one row per window, first starts by aggregation."""
    found = docs.join(marked, "key")
    back = F.explode(F.sequence(F.lit(0), F.lit(length - GRAM))).alias("back")
    windows = found.select("key", "data", F.col("low").alias("at"), back).where("at >= back").select(
        "key", (F.col("at") - F.col("back")).alias("start"), F.expr(f"substring(data, cast(at - back as int) + 1, {length})").alias("bytes")
    )
    windows = windows.where(F.octet_length("bytes") == length).distinct()
    first = windows.groupBy("bytes").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = windows.join(first.where("n > 1"), "bytes").where(F.col("first") != F.struct("key", "start"))
    return later.select("key", F.col("start").alias("low"), (F.col("start") + length).alias("high"))


def without_earlier(
    docs: DataFrame,
    length: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
    texts: bool = True,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the kept bytes.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Strings are judged on the input, as UTF-8 bytes, and never cross documents. Null texts
    count as empty. Rows that share an id, or have none, stay apart: they come in an order fixed by their text, null
    ids last. Texts shorter than ``length`` lose nothing; very long ones are handled whole, one row in one task.
    Extra columns are ignored; an empty table gives no rows. Equal surroundings are told by 64-bit hashes
    beside the anchor's own; everything else compares bytes.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("data"))
    ids = source.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[2]:
        keyed = source.withColumn("key", F.col("doc_id"))
    else:
        ordered = source.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("data"), F.octet_length("data"))
        keyed = staged(ordered.withColumn("key", F.monotonically_increasing_id()), "ordered")
    found = keyed.select("key", "data").mapInArrow(lambda it: _find_anchors(it, length), ROWS)
    order = ["anchor", "around", "key", "low"]
    grouped = found.repartition("anchor").sortWithinPartitions(*order)
    resolved = staged(grouped.mapInArrow(lambda it: _resolve(it, length), ROWS), "anchors")
    covers = [resolved.where("around = 0").select("key", "low", "high")]
    marks = resolved.where("around <> 0").select("anchor", "key", "low")

    large = staged(marks.groupBy("anchor").count().where(F.col("count") > group_limit).select("anchor"), "large")
    if not large.isEmpty():
        covers.append(_large_groups(marks.join(large, "anchor", "left_semi").select("key", "low"), keyed, length))
        marks = marks.join(large, "anchor", "left_anti")
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("anchor", "low")).alias("marks"))
    around = keyed.select("key", "data").join(marks.hint("shuffle_hash"), "key").select("key", "data", "marks")
    around = around.mapInArrow(lambda it: _surroundings(it, length), "anchor long, key long, at long, after binary, before binary")
    compared = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda it: _compare(it, length), "key long, low long, high long"
    )
    covers.append(staged(compared, "covers"))
    every = covers[0]
    for more in covers[1:]:
        every = every.unionAll(more)
    ranges = every.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = keyed.join(ranges.hint("shuffle_hash"), "key", "left").select("doc_id", "data", "ranges")
    return joined.mapInArrow(lambda it: _cut(it, texts), schema + (", kept binary" if texts else ""))
