"""Benchmark decontamination: a broadcast hash set of benchmark n-grams meets every window of training words.

Benchmark texts give their windows of ``width`` consecutive words, a shorter one a single window. Distinct windows and
their items go to every task as a hash set, in slices of at most MAX_BYTES: one slice for usual benchmarks, one pass over
the documents per slice for larger ones. A pass hashes all word windows of the texts at once; windows whose hash is in the
set are compared word by word, and the words they cover become spans to remove, or mark the document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.words import LOWERED, texts, words
from tillwise.session import staged

WIDTH = 10
#: Bytes of windows and item names in one slice of the hash set; a single longer window makes a longer slice.
MAX_BYTES = 32 << 20
#: Words whose windows are hashed at once.
CHUNK = 1 << 20
FOUND = "n_words long, starts array<long>, ends array<long>, items array<string>"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            w = words(text)
            if not w:
                continue
            for low in range(0, max(1, len(w) - width + 1), 4096):
                found = {b" ".join(w[i : i + width]) for i in range(low, min(low + 4096, max(1, len(w) - width + 1)))}
                columns = [pa.array([item] * len(found), pa.string()), pa.array(list(found), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "window"])


class HashSet:
    """Windows by length: sorted hashes, the words behind each hash, and the items that hold it."""

    def __init__(self, items: Sequence[str | None], windows: Sequence[bytes]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i in items if i is not None})
        number = {name: i for i, name in enumerate(self.names)}
        held: dict[bytes, list[int]] = {}
        for item, window in zip(items, windows):
            own = held.setdefault(window, [])
            if item is not None:
                own.append(number[item])
        by_length: dict[int, tuple[list, list]] = {}
        for window, own in held.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in window.split(b" ")]
            rows, names = by_length.setdefault(len(ids), ([], []))
            rows.append(ids)
            names.append(np.array(sorted(own), np.int32))
        self.lengths: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]] = []
        rows = {n: np.array(r, np.int32) for n, (r, _) in by_length.items()}
        # Another seed until no two windows share a hash; then equal words are the only way to verify a hit.
        for seed in range(1000):
            self.values = np.random.default_rng(seed).integers(0, 2**64, len(self.vocabulary) + 1, np.uint64)
            hashes = {n: self.rolled(self.values[r.T]) for n, r in rows.items()}
            if all(len(np.unique(h)) == len(h) for h in hashes.values()):
                break
        else:
            raise AssertionError("no seed tells all windows apart")
        for n in sorted(rows):
            order = np.argsort(hashes[n])
            likely = np.zeros(1 << _FILTER_BITS, bool)
            likely[hashes[n] >> np.uint64(64 - _FILTER_BITS)] = True
            names = by_length[n][1]
            self.lengths.append((n, hashes[n][order], rows[n][order], [names[i] for i in order], likely))

    @staticmethod
    def rolled(values: Sequence[np.ndarray]) -> np.ndarray:
        """Polynomial hash of aligned sequences, mixed so that the high bits depend on all words."""
        h = np.zeros(len(values[0]), np.uint64)
        for v in values:
            h *= _FACTOR
            h += v
        h ^= h >> np.uint64(29)
        h *= _FACTOR
        return h

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int32, len(found))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(length, places, windows, items of windows) of verified hits; -1 stands for unknown words and borders."""
        known = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(ids >= 0, out=known[1:])
        values = self.values[ids]
        for n, hashes, rows, names, likely in self.lengths:
            count = len(ids) - n + 1
            if count <= 0:
                continue
            whole = known[n:] - known[:count] == n
            if not whole.any():
                continue
            h = self.rolled([values[j : j + count] for j in range(n)])
            places = np.nonzero(whole & likely[h >> np.uint64(64 - _FILTER_BITS)])[0]
            at = np.minimum(np.searchsorted(hashes, h[places]), len(hashes) - 1)
            same = hashes[at] == h[places]
            places, at = places[same], at[same]
            same = (ids[places[:, None] + np.arange(n)] == rows[at]).all(axis=1)
            if same.any():
                yield n, places[same], at[same], names


def _chunks(found: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, w in enumerate(found):
        if i > low and size + len(w) > CHUNK:
            yield low, i
            low, size = i, 0
        size += len(w) + 1
    if low < len(found):
        yield low, len(found)


def _scanned(table: HashSet, data: list[bytes | None]) -> list[tuple[int, np.ndarray, np.ndarray, set[str]] | int]:
    """Per text: its number of words, and where any is hit also starts and ends of the runs and the items."""
    found, out = [words(t) for t in data], []
    for low, high in _chunks(found):
        sizes = np.array([len(w) for w in found[low:high]], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)]
        ids = np.full(starts[-1], -1, np.int32)
        for w, s in zip(found[low:high], starts):
            ids[s : s + len(w)] = table.numbers(w)
        cover, items = np.zeros(len(ids) + 1, np.int32), {}
        for n, places, at, names in table.hits(ids):
            cover[places] += 1
            cover[places + n] -= 1
            of_text = np.searchsorted(starts, places, "right") - 1
            for d, a in set(zip(of_text.tolist(), at.tolist())):
                items.setdefault(d, set()).update(names[a].tolist())
        hit = np.diff(np.r_[0, np.cumsum(cover[:-1]) > 0, 0].astype(np.int8))
        first, last = np.nonzero(hit == 1)[0], np.nonzero(hit == -1)[0]
        of_run = np.searchsorted(starts, first, "right") - 1
        for i, n in enumerate(sizes.tolist()):
            if i in items:
                own = of_run == i
                out.append((n, first[own] - starts[i], last[own] - starts[i], {table.names[x] for x in items[i]}))
            else:
                out.append(n)
    return out


def merged(starts: Sequence[int], ends: Sequence[int]) -> tuple[list[int], list[int]]:
    """Runs in order, those that touch or overlap made one."""
    low: list[int] = []
    high: list[int] = []
    for s, e in sorted(zip(starts, ends)):
        if high and s <= high[-1]:
            high[-1] = max(high[-1], e)
        else:
            low.append(s), high.append(e)
    return low, high


def _pass(batches: Iterator[pa.RecordBatch], table, text: int, earlier: int | None, keep: list[int], names: list[str], found_type: pa.DataType):
    for batch in batches:
        before = batch.column(earlier).to_pylist() if earlier is not None else repeat(None)
        rows = []
        for now, old in zip(_scanned(table.value, texts(batch.column(text))), before):
            n, starts, ends, items = (now, (), (), ()) if isinstance(now, int) else (now[0], now[1].tolist(), now[2].tolist(), now[3])
            if old:
                starts, ends = merged([*starts, *old["starts"]], [*ends, *old["ends"]])
                items = {*items, *old["items"]}
            rows.append({"n_words": n, "starts": list(starts), "ends": list(ends), "items": sorted(items)})
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows, found_type)], names=names)


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_column: str, width: int, max_bytes: int, item_column: str, item_text: str) -> tuple[DataFrame, str]:
    """The columns ``keep`` of all rows and one more, a struct of FOUND, under a name that the table lacks."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    source = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    pairs = staged(source.mapInArrow(lambda it: _windows(it, width), "item string, window binary").distinct(), "windows")
    size = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    slices = max(1, math.ceil((pairs.agg(F.sum(size)).first()[0] or 0) / max_bytes))
    name = "found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    struct = StructType.fromDDL(FOUND)
    arrow = to_arrow_type(struct)
    now, earlier = docs, None
    for i in range(slices):
        last = i == slices - 1
        # At most MAX_BYTES of windows come to the driver and go to the tasks.
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == i).toArrow()
        table = spark.sparkContext.broadcast(HashSet(part.column("item").to_pylist(), part.column("window").to_pylist()))
        kept = keep if last else docs.columns
        schema = StructType([*(now.schema[c] for c in kept)]).add(name, struct)
        places = [now.columns.index(c) for c in kept]
        at, old = now.columns.index(text_column), earlier
        now = now.mapInArrow(lambda it, t=table, p=places, s=schema, at=at, old=old: _pass(it, t, at, old, p, s.names, arrow), schema)
        if not last:
            now, earlier = staged(now, "found"), len(docs.columns)
    return now, name


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
    max_bytes: int = MAX_BYTES, item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside benchmark windows), spans (runs of hit words as start and
    end, words from 0) and items (ids, as strings, of benchmark items with windows in the text, sorted).

    Words are runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased. Null, empty and wordless texts have no
    words and no hits; null or wordless benchmark texts give no window. Items without id hit, but are not listed; rows
    that repeat an id are one item. Repeated documents each give a row, rows without id too; extra columns of any name are
    ignored. An empty benchmark hits nothing, an empty table gives no rows. Texts of any length are scanned whole.
    """
    found, name = _found(docs.select(id_column, text_column), benchmark, [id_column], text_column, width, max_bytes, item_column, item_text)
    spans = F.arrays_zip(F.col(f"{name}.starts").alias("start"), F.col(f"{name}.ends").alias("end"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col(id_column).alias("doc_id"), F.col(f"{name}.n_words").alias("n_words"), hit.alias("n_hit"),
        spans.alias("spans"), F.col(f"{name}.items").alias("items"),
    )


def without_spans(text: str, starts: Sequence[int], ends: Sequence[int]) -> str:
    """The text without the words of the runs and what stands between them; words from 0, ends exclusive."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(LOWERED))]
    out, at = [], 0
    for s, e in zip(starts, ends):
        out.append(data[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch], text: int, found: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, runs = batch.column(text).to_pylist(), batch.column(found).to_pylist()
        cut = [without_spans(t, r["starts"], r["ends"]) if r["starts"] else t for t, r in zip(column, runs)]
        columns = [pa.array(cut, batch.column(text).type) if i == text else batch.column(i) for i in range(found)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_column: str = "text", width: int = WIDTH,
    max_bytes: int = MAX_BYTES, item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window (``remove="documents"``), or with the words
    of such windows, and what stands between them, cut from their texts (``remove="spans"``). Nulls and odd rows as in
    ``contamination``; a null text stays null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found, name = _found(docs, benchmark, docs.columns, text_column, width, max_bytes, item_column, item_text)
    if remove == "documents":
        return found.where(F.size(f"{name}.starts") == 0).drop(name)
    names, at = docs.columns, docs.columns.index(text_column)
    return found.mapInArrow(lambda it: _cut(it, at, len(names), names), docs.schema)
