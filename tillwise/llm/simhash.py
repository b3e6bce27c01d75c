"""Near-duplicates by SimHash, linked through per-segment bit counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. Changing one bit
changes one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance
of the fingerprints. The segments form three groups; if the whole Manhattan distance is at most four, some
group's share of it is at most one. Each fingerprint therefore lies in one grid cell per group, its counts
there, and is also sent to the cells one step up. Fingerprints that meet in a cell are verified by their
exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.graphs import components
from tillwise.session import staged

#: Bits of a group's segments: three groups, so that a distance of 4 leaves one group with at most 1.
GROUPS = ((0, 11), (11, 11), (22, 10))
RADIUS = 4
#: Rows of a cell beyond which its comparisons are spread over several tasks.
CELL_LIMIT = 20_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash over the XXH64 of all word shingles; a bit is set if more than half of the hashes set it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Home cell of each fingerprint in each group, and the cells one step up from it."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        pairs = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))  # bit counts of two-bit segments
        cells, owners, homes = [], [], []
        for g, (first, n) in enumerate(GROUPS):
            digits = [((pairs >> np.uint64(2 * (first + i))) & np.uint64(3)).astype(np.int64) for i in range(n)]
            key = sum(d * 3**i for i, d in enumerate(digits)) + g * 3**11
            cells.append(key), owners.append(fps), homes.append(np.ones(len(fps), bool))
            for i, d in enumerate(digits):
                up = d < 2
                cells.append(key[up] + 3**i), owners.append(fps[up]), homes.append(np.zeros(int(up.sum()), bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cells)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(homes))],
            names=["cell", "fp", "home"],
        )


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the smallest index known to be reachable."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(homes: np.ndarray, others: np.ndarray, radius: int = RADIUS, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of a cell just as all its pairs within ``radius`` do.

    At most one link per fingerprint is returned; memory is bounded by ``block`` pairs.
    """
    members = np.concatenate([homes, others])
    label = np.arange(len(members))
    step = max(1, block // len(members))
    for i in range(0, len(homes), step):
        near = np.bitwise_count(homes[i : i + step, None] ^ members[None, :]) <= radius
        a, b = np.nonzero(near)
        a += i
        keep = a != b
        if keep.any():
            label = _merge(label, a[keep], b[keep])
    linked = np.nonzero(label != np.arange(len(members)))[0]
    return members[linked], members[label[linked]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (cell, chunk); rows come sorted by them, homes of the chunk first."""

    def links(rows: list[tuple]) -> list:
        homes = np.concatenate([f[h] for f, h in rows])
        others = np.concatenate([f[~h] for f, h in rows])
        return [spanning_links(homes, others)] if len(homes) and len(homes) + len(others) > 1 else []

    key, open_rows = None, []
    for batch in batches:
        cell, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fps = batch.column(2).to_numpy().view(np.uint64)
        home = batch.column(3).to_numpy(zero_copy_only=False)
        found = []
        edges = np.nonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0))[0] + 1
        for i, j in zip([0, *edges], [*edges, len(cell)]):
            if i == j:
                continue
            if open_rows and key != (cell[i], chunk[i]):
                found += links(open_rows)
                open_rows = []
            key = (cell[i], chunk[i])
            open_rows.append((fps[i:j], home[i:j]))
        yield _links(found)
    if open_rows:
        yield _links(links(open_rows))


def _links(found: list) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
    differ = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[differ].view(np.int64)), pa.array(b[differ].view(np.int64))], names=["a", "b"])


def near_links(fps: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column ``fp`` that connect all pairs within four bits."""
    rows = fps.mapInArrow(_cells, "cell long, fp long, home boolean")
    sizes = rows.groupBy("cell").count().where(F.col("count") > cell_limit)
    large = staged(sizes.select("cell", F.ceil(F.col("count") / cell_limit).alias("chunks")), "cells")
    if large.isEmpty():
        spread = rows.withColumn("chunk", F.lit(0).cast("long"))
    else:
        # A large cell is dealt in chunks of homes; each chunk meets all members of the cell.
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        chunks = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        spread = rows.join(large, "cell", "left").withColumn("chunk", F.explode(chunks))
        spread = spread.withColumn("home", F.col("home") & (F.col("chunks").isNull() | (own == F.col("chunk"))))
    keyed = spread.select("cell", "chunk", "fp", "home").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk")
    return keyed.mapInArrow(_verify, "a long, b long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Words are lower-cased in A-Z and split at ASCII white space; shingles have four words, repeats count. A text
    of one to three words is one shingle; a null, empty or blank text has fingerprint zero and is linked like any
    other. Rows with null ids belong to components but never name them (the id is null if all are null). Repeated
    rows each give a row; extra columns are ignored; an empty table gives no rows.

    Only distinct fingerprints are compared, and a cell returns links that span it, not all its pairs.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    marked = staged(source.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    first = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    linked = components(near_links(first.select("fp"), cell_limit))
    joined = first.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    names = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(joined.join(names, "component").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, without those whose group of near-duplicates has a smaller doc_id.

    Rows without id are kept, as no rule names them; rows that repeat an id and are kept stay repeated.
    """
    groups = near_groups(docs, id_column, text_column)
    dropped = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(dropped.withColumnRenamed("doc_id", id_column), id_column, "left_anti").select(*docs.columns)
