"""Large ``{key: value}`` JSON documents, read by as many tasks as Spark cuts the file into.

Spark's text reader splits a file at commas. Whether a comma ends an entry depends on all text before it, so a first pass
reduces each file split to its quotes' parity and its net nesting, for a start inside and outside a string; running sums
over the splits give every split's true start. A second pass cuts the entries. An entry that lies in one split is
never shuffled, only the pieces at the edges of splits are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from tillwise.session import staged

#: Splits whose starts are broadcast, about 100 bytes each; beyond, pieces meet their split's start through a shuffle.
BROADCAST_SPLITS = 100_000
#: Pieces of an entry that other splits share: its end, its whole middle, its start.
_WHOLE, _HEAD, _MIDDLE, _TAIL = 0, 1, 2, 3


def _scanner():
    """A function of (text, in string, depth) -> (parity of quotes, net depth, ends of top-level entries), made for tasks."""
    escape = re.compile(rb"\\.", re.DOTALL)
    step = np.zeros(256, np.int64)
    step[[ord("{"), ord("[")]], step[[ord("}"), ord("]")]] = 1, -1

    def scan(data: bytes, inside: int, depth: int) -> tuple[int, int, np.ndarray]:
        text = np.frombuffer(escape.sub(b"__", data), np.uint8)
        quotes = np.cumsum(text == ord('"'))
        outside = (quotes + inside) % 2 == 0
        level = np.cumsum(np.where(outside, step[text], 0))
        ends = np.flatnonzero((text == ord(",")) & outside & (level + depth == 1))
        return int(quotes[-1] % 2), int(level[-1]), ends

    return scan


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame, bytes]]:
    """Consecutive rows of one split within a batch, with their text; the comma after each piece is put back."""
    for batch in batches:
        where = (batch["path"] != batch["path"].shift()) | (batch["split"] != batch["split"].shift())
        for _, run in batch.groupby(where.cumsum(), sort=False):
            yield (run["path"].iloc[0], int(run["split"].iloc[0])), run, (",".join(run["value"]) + ",").encode()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scan, sums = _scanner(), {}
    for place, _, data in _runs(batches):
        parity, out, within = sums.get(place, (0, 0, 0))
        flip, net, _ = scan(data, parity, 0)
        sums[place] = ((parity + flip) % 2, out + net, within + scan(data, 1 - parity, 0)[1])
    yield pd.DataFrame([(*p, *s) for p, s in sums.items()], columns=["path", "split", "parity", "net_outside", "net_inside"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scan, place, kept, cut = _scanner(), None, [], False

    def rest():
        return (*place, _TAIL if cut else _MIDDLE, b"".join(kept).decode())

    for here, run, data in _runs(batches):
        rows = []
        if here != place:
            if place is not None:
                rows.append(rest())
            place, kept, cut, inside, depth = here, [], False, int(run["inside"].iloc[0]), int(run["depth"].iloc[0])
        flip, net, ends = scan(data, inside, depth)
        inside, depth, start = (inside + flip) % 2, depth + net, 0
        for end in ends.tolist():
            rows.append((*place, _WHOLE if cut else _HEAD, b"".join([*kept, data[start:end]]).decode()))
            kept, cut, start = [], True, end + 1
        kept.append(data[start:])
        yield pd.DataFrame(rows, columns=["path", "split", "part", "text"])
    if place is not None:
        yield pd.DataFrame([rest()], columns=["path", "split", "part", "text"])


def _starts(pieces: DataFrame) -> DataFrame:
    """Per split: whether it starts in a string, and how deep."""
    sums = pieces.mapInPandas(_summaries, "path string, split long, parity int, net_outside long, net_inside long")
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    started = sums.withColumn("inside", F.coalesce(F.sum("parity").over(before) % 2, F.lit(0)).cast("int"))
    net = F.when(F.col("inside") == 1, F.col("net_inside")).otherwise(F.col("net_outside"))
    return started.withColumn("depth", F.coalesce(F.sum(net).over(before), F.lit(0)).cast("int")).select("path", "split", "inside", "depth")


def read_entries(spark: SparkSession, path: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """One row (path, entry) per top-level entry ``"key": value`` of each document under ``path``, as JSON text.

    Documents are UTF-8, one object per file. White space around entries and documents does not matter; an empty document
    has no entry. A task holds one batch of pieces and the entry being read.
    """
    text = spark.read.option("lineSep", ",").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    starts = staged(_starts(pieces), "splits")
    if starts.count() <= broadcast_splits:
        placed = pieces.join(F.broadcast(starts), ["path", "split"])
    else:
        placed = pieces.withColumn("_order", F.monotonically_increasing_id()).join(starts, ["path", "split"])
        placed = placed.repartition("path", "split").sortWithinPartitions("path", "split", "_order").drop("_order")
    cut = staged(placed.mapInPandas(_cut, "path string, split long, part int, text string"), "entries")
    edges = cut.filter(F.col("part") != _WHOLE)
    # An entry begins with each tail; its pieces are numbered without their texts.
    upto = W.partitionBy("path").orderBy("split", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("path")
    numbered = edges.select("path", "split", "part").withColumn("nth", F.sum((F.col("part") == _TAIL).cast("long")).over(upto))
    numbered = numbered.withColumn("last", F.max("nth").over(every))
    whole = edges.join(numbered, ["path", "split", "part"]).groupBy("path", "nth", "last").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "part", "text"))), lambda s: s["text"]), "").alias("entry")
    )
    opened = F.when(F.col("nth") == 0, F.regexp_replace("entry", r"^[\s\uFEFF]*\{", "")).otherwise(F.col("entry"))
    closed = F.when(F.col("nth") == F.col("last"), F.regexp_replace(opened, r"\}\s*,\s*$", "")).otherwise(opened)
    entries = whole.select("path", closed.alias("entry")).unionByName(cut.filter(F.col("part") == _WHOLE).select("path", F.col("text").alias("entry")))
    return entries.filter(F.trim(F.regexp_replace("entry", r"\s+", " ")) != "")


def read_keyed_split(spark: SparkSession, path: str, schema: T.MapType, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Like :func:`tillwise.sources.documents.read_keyed`, for documents too large for one row."""
    entries = read_entries(spark, path, broadcast_splits)
    rows = entries.select(F.explode(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), schema)).alias("key", "value"))
    return rows.select("key", "value.*") if isinstance(schema.valueType, T.StructType) else rows


def write_keyed_documents(df: DataFrame, path: str, key: str, documents: int = 1) -> None:
    """Write ``documents`` files, each one ``{key: {...}}`` object of the rows whose key hashes to it.

    NULL keys are left out; keys are distinct. An object is put together in one task, so ``documents`` grows with the rows.
    """
    rest = [c for c in df.columns if c != key]
    bucket = F.pmod(F.xxhash64(key), F.lit(documents))
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*rest).alias("value"))
    objects = df.filter(F.col(key).isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    objects.select(F.to_json("m").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
