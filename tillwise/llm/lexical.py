"""Ranked lexical search with hashed max-sketches.

The impact of a term in a document is what it adds to the score of any query that holds it. A document's impacts are folded
into a sketch: each term is hashed to one of WIDTH coordinates, which keeps the largest impact it meets. The sum of
a query's coordinates is an upper bound of its score; sketches of a chunk of documents lie coordinate by coordinate, so a
batch of queries looks its bounds up in whole rows. Documents are rescored exactly in the order of falling bounds, until
the next bound is below the k-th best score. Tasks keep k documents per query, which Spark merges.

Impacts of terms that no query holds can only loosen bounds, so they are left out of the sketches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.llm.topk import Best
from tillwise.llm.words import ranges, texts, words
from tillwise.session import staged

WIDTH = 1024
#: Documents and words that are sketched at once.
CHUNK_DOCS, CHUNK_WORDS = 2048, 1 << 20
#: Documents rescored before the threshold is looked at again.
RESCORED = 32
#: Bytes of query terms that go to the tasks in one pass; a single longer query makes a longer one.
MAX_BYTES = 32 << 20


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(texts(batch.column(1))):
            own = list(set(words(text)))
            if own:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(own))), pa.array(own, pa.binary())], names=["item", "term"])


class Queries:
    """A batch of queries: their ids and terms, numbered over the batch."""

    def __init__(self, rows: pa.Table):
        self.vocabulary: dict[bytes, int] = {}
        held: dict = {}
        for item, term in zip(rows.column("item").to_pylist(), rows.column("term").to_pylist()):
            held.setdefault(item, []).append(self.vocabulary.setdefault(term, len(self.vocabulary)))
        self.ids = pa.array(list(held), rows.schema.field("item").type)
        self.terms = [np.array(sorted(t), np.int64) for t in held.values()]
        self.slots = np.fromiter((zlib.crc32(t) % WIDTH for t in self.vocabulary), np.int64, len(self.vocabulary))

    def counted(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple]:
        """Chunks of documents: (batch, rows of it, words of each, and (document, term, occurrences) in order)."""
        get, v = self.vocabulary.get, max(1, len(self.vocabulary))

        def chunk(batch, low, sizes, keys):
            found, tf = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
            return batch, low, np.array(sizes, np.int64), found // v, found % v, tf

        for batch in batches:
            low, sizes, keys, held = 0, [], [], 0
            for i, data in enumerate(texts(batch.column(text))):
                own = words(data)
                ids = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                keys.append(ids[ids >= 0] + v * len(sizes))
                sizes.append(len(own))
                held += len(own)
                if len(sizes) == CHUNK_DOCS or held >= CHUNK_WORDS:
                    yield chunk(batch, low, sizes, keys)
                    low, sizes, keys, held = i + 1, [], [], 0
            if sizes:
                yield chunk(batch, low, sizes, keys)


def _statistics(batches: Iterator[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    """Per task: documents that hold each query term; -1 counts documents with any term, -2 all terms."""
    q = queries.value
    df = np.zeros(len(q.vocabulary) + 2, np.int64)
    for _, _, sizes, _, term, _ in q.counted(batches, 0):
        df[:-2] += np.bincount(term, minlength=len(q.vocabulary))
        df[-1] += np.count_nonzero(sizes)
        df[-2] += sizes.sum()
    names = np.r_[np.arange(len(q.vocabulary)), -2, -1].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(names[df > 0]), pa.array(df[df > 0])], names=["term", "n"])


def sketched(doc: np.ndarray, slot: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Coordinatewise maxima of the documents' impacts, one row per coordinate."""
    sketch = np.zeros((WIDTH, docs), np.int64)
    np.maximum.at(sketch.reshape(-1), slot * docs + doc, impact)
    return sketch


def _search(batches: Iterator[pa.RecordBatch], queries, weight: np.ndarray, n_docs: int, n_words: int, k: int) -> Iterator[pa.RecordBatch]:
    q = queries.value
    best, mark = Best(len(q.terms), k), np.zeros(len(weight), np.int64)
    for batch, low, sizes, doc, term, tf in q.counted(batches, 1):
        if not len(doc):
            continue
        ids = batch.column(0).slice(low, len(sizes))
        named = np.array(ids.is_valid())
        ids = np.array(ids.fill_null(0), np.int64)
        m = 10 + (90 * sizes * n_docs) // n_words
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        sketch = sketched(doc, q.slots[term], impact, len(sizes))
        sketch[:, ~named] = 0
        starts = np.searchsorted(doc, np.arange(len(sizes) + 1))
        for i, own in enumerate(q.terms):
            bound = sketch[q.slots[own]].sum(axis=0)
            likely = np.nonzero((bound > 0) & (bound >= best.least[i]))[0]
            likely = likely[np.argsort(-bound[likely], kind="stable")]
            mark[own] = 1
            for at in range(0, len(likely), RESCORED):
                some = likely[at : at + RESCORED]
                if bound[some[0]] < best.least[i]:
                    break
                places, of = ranges(starts[some], starts[some + 1])
                score = np.zeros(len(some), np.int64)
                np.add.at(score, of, impact[places] * mark[term[places]])
                good = (score > 0) & (score >= best.least[i])
                best.add(np.full(int(good.sum()), i), ids[some[good]], score[good])
            mark[own] = 0
    found = [(i, name, -int(minus)) for i, rows in enumerate(best.rows) for minus, name in rows]
    if found:
        item, name, score = zip(*found)
        yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(item)), pa.array(name, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents of scores above 0; ties go to the smaller doc_id.

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased. With N documents that hold a term, L terms
    in all, n of them in the document, df documents that hold the term and tf occurrences: w = floor(1000 ln((2N+2)/(2df+1))),
    m = 10 + (90 n N) div L, and the score adds w * ((10^9 tf) div (1000 tf + 8 m)) for each distinct term of the item.

    Null and empty texts have no terms: such documents count nowhere, such items give no rows. Rows without doc_id count in
    the statistics but are never returned; rows that repeat a doc_id are each ranked. Items without id are ignored, rows of
    one item_id are one item. Extra columns are ignored. Empty tables give no rows. Items beyond ``max_bytes`` of
    terms are searched in several passes over the documents.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_column].dataType
    named = items.where(F.col(item_column).isNotNull()).select(F.col(item_column).alias("item"), F.col(item_text).alias("text"))
    schema = named.schema.fields[0]
    terms = named.mapInArrow(_query_terms, f"item {schema.dataType.simpleString()}, term binary").distinct()
    terms = staged(terms, "query-terms")
    slices = max(1, math.ceil((terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) / max_bytes))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    results = []
    for i in range(slices):
        part = terms.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).toArrow()
        queries = Queries(part)
        shared = spark.sparkContext.broadcast(queries)
        counts = source.select("text").mapInArrow(lambda it, s=shared: _statistics(it, s), "term int, n long")
        df = dict(map(tuple, counts.groupBy("term").agg(F.sum("n")).collect()))
        n_docs, n_words = df.get(-1, 0), df.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(queries.vocabulary))], np.int64)
        results.append(
            source.mapInArrow(
                lambda it, s=shared, w=weight, n=n_docs, length=max(1, n_words): _search(it, s, w, n, length, k),
                f"item_id {item_type.simpleString()}, doc_id long, score long",
            )
        )
    found = results[0]
    for other in results[1:]:
        found = found.unionAll(other)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
